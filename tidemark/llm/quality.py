"""Quality rules with risk-controlled thresholds.

Each rule scores a document (higher is worse) and rejects from a cutoff on. Labelled documents that are known to be good
choose the cutoffs, in two parts that share no text. The first part, of all strata together, orders the rules into one
sequence of ever weaker rejections: at level a, each rule rejects from the lowest cutoff of a fixed grid that at most a share
a of the part's good documents reach. The second part certifies, in each stratum (a language): from the strictest level on, an exact
binomial (Clopper-Pearson) test asks whether the true rate of good documents that all rules together reject is at most `RISK`.
Levels are tested in this fixed sequence until one fails, so they need no correction among themselves; strata are corrected
for (Bonferroni). All strata then keep within `RISK` at once with probability 1 - `DELTA`, and a stratum takes the
last level that passed. One without enough labels (some 220 good ones at four strata) rejects nothing beyond the base rules.

Copies of a text, and rows that repeat a document, count once among the labelled documents, since they are no
independent trials. All work on documents is in DataFrame expressions, a row at a time; only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

RISK, DELTA, WINDOW, FEWEST, REPEATS = 0.02, 0.05, 5, 10, 20
WORD_GAP = "[ \\t-\\r]+"
#: Cutoffs that are tried for each rule; scores are shares from 0 to 1.
GRID = [k / 40 for k in range(1, 41)]
#: Levels of the sequence, from the strictest. Weaker ones reject more good documents and hardly more bad ones.
LEVELS = [0.0, 0.0005, 0.001]
#: One labelled document of so many orders the rules; the others certify.
PARTS = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, block: int = 256) -> Column:
    """Of an array of integers, the sum of those before each. Expressions have no running sum; adding up inside blocks,
    and the blocks before, keeps the work far from the square of the size."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block_of = lambda i: F.call_function("div", i, F.lit(block)).cast("int")

    def whole(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block_of(F.size(a))), lambda c: total(F.slice(a, c * block + 1, F.lit(block))))
        before = lambda s: F.transform(s, lambda x, c: total(F.slice(s, F.lit(1), c)))
        return let(let(sums, before), lambda b: F.transform(a, lambda x, i: F.get(b, block_of(i)) + total(F.slice(a, block_of(i) * block + 1, i - block_of(i) * block))))

    return let(sizes, whole)


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the array, the first one included."""

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda e, j, step: (j + step >= 0) & F.coalesce(F.get(s, j + step)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j, -1) | same(e, j, 1)), lambda e: e["i"]))

        def spans(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, places), spans))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measures(text: Column) -> Column:
    """All counts of a whole text, as a struct. Null: as empty."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return F.struct(
        of_words.alias("w"), repeated_lines(text).alias("l"), count_of(text, "[#*$%&|<>]").cast("long").alias("n_symbols"),
        count_of(text, "[A-Z]").cast("long").alias("n_upper"), count_of(text, "[!?]").cast("long").alias("n_marks"),
    )


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of docs, and each count as a column."""
    m = docs.select(*(F.col(f"`{c}`") for c in keep), measures(F.col(f"`{text}`")).alias("__m"), F.xxhash64(F.col(f"`{text}`")).alias("__copy"))
    return m.select(*(F.col(f"`{c}`") for c in keep), "__copy", *(F.col(f"__m.{c}").alias(f"__{c.rpartition('.')[2]}") for c in ("w.n_words", "w.word_chars", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "n_symbols", "n_upper", "n_marks")))


def base_failed() -> Column:
    return (F.col("__n_words") < FEWEST) | (100 * F.col("__n_repeat_words") > REPEATS * F.col("__n_words"))


def rules() -> dict[str, Column]:
    """Each rule's score, a share from 0 to 1."""
    share = lambda a, b: F.coalesce(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))), F.lit(0.0))
    return {
        "symbols": share("__n_symbols", "__n_words"),
        "marks": share("__n_marks", "__n_words"),
        "shouting": share("__n_upper", "__word_chars"),
        "lines": share("__n_dup_lines", "__n_lines"),
        "repeats": share("__n_repeat_words", "__n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials at rate p: the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if k >= n:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        total = d
        for m in range(1, 100_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                total *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return total

    def beta(x: float, a: float, b: float) -> float:
        front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        return front * fraction(x, a, b) / a

    a, b, x = n - k, k + 1, 1 - p
    return beta(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - beta(p, b, a)


def ordered_cutoffs(good: DataFrame) -> list[dict[str, float]]:
    """For each level, each rule's lowest cutoff that at most that share of good documents reach; a rule that none fits isn't there."""
    scores = rules()
    reach = good.agg(F.count("*").alias("n"), *(F.count_if(F.col(name) >= t).alias(f"{name}_{k}") for name in scores for k, t in enumerate(GRID))).first()
    fits = lambda name, k, level: reach[f"{name}_{k}"] <= level * reach["n"]
    return [{name: GRID[k] for name in scores if (k := next((k for k in range(len(GRID)) if fits(name, k, level)), None)) is not None} for level in LEVELS] if reach["n"] else []


def cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff. labels(doc_id, quality): 1 is good; where labels of a document differ, good wins."""
    scores = rules()
    good = labels.where("quality = 1").select("doc_id").distinct()
    cells = measures.where(~base_failed()).join(good, "doc_id", "left_semi").select("__copy", F.coalesce(F.col(stratum), F.lit("")).alias("s"), *(c.alias(name) for name, c in scores.items()))
    once = scratch.keep(cells.groupBy("__copy", "s").agg(*(F.first(name).alias(name) for name in scores)), "labelled")  # equal texts score alike
    mine = F.pmod(F.xxhash64("__copy"), F.lit(PARTS)) == 0
    levels = ordered_cutoffs(once.where(mine))
    if not levels:
        return {}
    rejected = lambda level: F.array_contains(F.array(F.lit(False), *(F.col(name) >= t for name, t in level.items())), True)
    counts = once.where(~mine).groupBy("s").agg(F.count("*").alias("n"), *(F.count_if(rejected(level)).alias(f"k_{j}") for j, level in enumerate(levels))).collect()  # a row for each stratum
    scratch.drop(once)
    out: dict[str, dict[str, float]] = {}
    for row in counts:
        for j, level in enumerate(levels):
            if binomial_tail(row[f"k_{j}"], row["n"], risk) > delta / len(counts):
                break
            out[row["s"]] = level
    return out


def verdict(chosen: dict[str, dict[str, float]], stratum: str = "lang") -> Column:
    """True for documents that no base rule and no cutoff of their stratum rejects."""
    bad = base_failed()
    for name, score in rules().items():
        of = {s: t[name] for s, t in chosen.items() if name in t}
        if of:
            table = F.create_map(*(F.lit(x) for pair in sorted(of.items()) for x in pair))
            bad = bad | F.coalesce(score >= F.try_element_at(table, F.coalesce(F.col(stratum), F.lit(""))), F.lit(False))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, whole: bool = False, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row; with `whole`, docs' columns and kept.

    Null and empty texts have no words and fail. A null stratum is one of its own. Labels of documents that
    docs lacks, and null labels, count for nothing; no labels: only the base rules reject. Repeated rows are
    judged each. An empty table gives no rows. Columns of docs with other names pass unread.
    """
    scratch.long_rows(docs.sparkSession)
    carried = docs.columns if whole else ["doc_id", stratum]
    table = scratch.keep(measured(docs, carried), "measures")
    chosen = cutoffs(table, labels, stratum)
    kept = verdict(chosen, stratum)
    if whole:
        return table.select(*(F.col(f"`{c}`") for c in docs.columns), kept.alias("__kept"))
    return table.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed().alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject."""
    judged = judge(docs, labels, whole=True)
    return judged.where("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))
