"""Quality rules: a decision list learned from labelled statistics of texts.

Every text gets counts and shares (``statistics``), worked out where the row is read.
``learn`` covers the bad labelled documents one rule at a time. A rule is a conjunction of
thresholds on the shares. It grows by the condition with the largest information gain on
two thirds of the labelled rows, loses its last conditions again as long as that helps on
the other third, and is kept if it is precise enough; the rows it covers are then left out.
Candidate thresholds are the values of each share with two significant digits, so each
step is one aggregation to features x digits rows, of which the best one is collected. All
labelled rows are used, however many. ``verdict`` writes the rules as one ordered
conditional expression.

Words are runs of characters other than ASCII white space. A null text has none. Ids whose
``crc32(id as text) mod 5`` is 0 are never learned from, nor are rows without an id or with
another label than 0 and 1; an id with both labels counts as 0. Without labels there are no
rules. Repeated windows are told by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.llm.common import utf8, whole_text
from popatlas.plans.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"[A-Z]"
STOPS = r"[.,;:!?]"
WINDOW = 8  # three doublings
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent of the words

MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_COVER = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "words",
    "word_length",
    "symbol_share",
    "upper_share",
    "stop_share",
    "repeat_share",
    "dup_line_share",
    "line_words",
)


def _per(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _next_to(hashes: str, by: int) -> Column:
    """Each hash with the one ``by`` places on. The last ``by`` have none and mean nothing."""
    later = F.slice(hashes, by + 1, F.size(hashes))
    return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of ``COUNTS`` (long) and ``SHARES`` (double).

    Each step is a projection of its own, since what it makes is used more than once. A
    window's hash is made of those of its words in three doublings. Only texts with a
    repeated window sort their windows.
    """
    text, words, lines, hashes, windows, placed, starts, upper, stops, n_lines = (
        f"{name}__{part}"
        for part in (
            "text words lines hashes windows placed starts upper stops n_lines".split()
        )
    )
    count = {part: f"{name}__{part}" for part in COUNTS}

    def twice(window: Column, place: Column) -> Column:
        earlier, later = F.get(placed, place - 1)["h"], F.get(placed, place + 1)["h"]
        return window["h"].eqNullSafe(earlier) | window["h"].eqNullSafe(later)

    none = F.array().cast("array<struct<h:bigint,i:int>>")
    in_order = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    # A window that starts less than WINDOW words after the one before adds the difference.
    added = F.transform(
        starts,
        lambda start, k: F.least(
            F.coalesce(F.get(starts, k + 1) - start, F.lit(WINDOW)), F.lit(WINDOW)
        ),
    )
    rows = (
        docs.withColumn(text, whole_text(text_col))
        .withColumns(
            {
                words: F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                lines: F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
            }
        )
        .withColumn(hashes, F.transform(words, lambda word: F.xxhash64(word)))
        .withColumn(windows, _next_to(hashes, 1))
        .withColumn(windows, _next_to(windows, 2))
        .withColumn(windows, _next_to(windows, 4))
        .withColumn(
            windows, F.slice(windows, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
        )
        .withColumn(
            placed,
            F.when(F.size(F.array_distinct(windows)) < F.size(windows), in_order).otherwise(none),
        )
        .withColumn(
            starts,
            F.sort_array(F.transform(F.filter(placed, twice), lambda window: window["i"])),
        )
        .withColumns(
            {
                count["n_words"]: F.size(words).cast("long"),
                count["word_chars"]: F.char_length(F.array_join(words, "")).cast("long"),
                count["n_symbols"]: F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                count["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                count["n_repeat_words"]: F.aggregate(
                    added, F.lit(0).cast("long"), lambda total, n: total + n
                ),
                upper: F.regexp_count(text, F.lit(CAPITALS)),
                stops: F.regexp_count(text, F.lit(STOPS)),
                n_lines: F.size(lines),
            }
        )
    )
    n_words, word_chars = count["n_words"], count["word_chars"]
    found = {part: F.col(column) for part, column in count.items()} | {
        "words": F.col(n_words).cast("double"),
        "word_length": _per(word_chars, n_words),
        "symbol_share": _per(count["n_symbols"], word_chars),
        "upper_share": _per(upper, word_chars),
        "stop_share": _per(stops, n_words),
        "repeat_share": _per(count["n_repeat_words"], n_words),
        "dup_line_share": _per(count["n_dup_lines"], n_lines),
        "line_words": _per(n_words, n_lines),
    }
    return rows.select(*docs.columns, F.struct(*[c.alias(k) for k, c in found.items()]).alias(name))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and the shares of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_statistics(rows, "text", "s").select("doc_id", "s.*")


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def holds(self, prefix: str = "") -> Column:
        value = F.col(f"{prefix}{self.feature}")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Conditions that all hold, and how many bad and good labelled rows they cover."""

    conditions: tuple[Condition, ...]
    bad: int = field(default=0, compare=False)
    good: int = field(default=0, compare=False)

    def holds(self, prefix: str = "") -> Column:
        return reduce(lambda a, b: a & b, [c.holds(prefix) for c in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f"  -- {self.bad} bad, {self.good} good"


def _labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``bad, grow`` and the shares of the documents to learn from."""
    number = F.crc32(utf8(F.col(id_col).cast("string")))
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (number % 5 != 0))
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg((F.min(label_col) == 0).alias("bad"))
    )
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    return stats.join(known, "doc_id").select("bad", grow.alias("grow"), *SHARES)


def _two_digits(value: Column) -> Column:
    """``value`` cut to two significant digits: never more, and 0 for 0."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 1)
    return F.when(value > 0, F.round(F.floor(value / unit) * unit, 9)).otherwise(F.lit(0.0))


def _cuts(rows: DataFrame) -> DataFrame:
    """``feature, threshold, bad, good``: rows by the thresholds their shares fall on."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("feature"), _two_digits(F.col(name)).alias("threshold"))
                for name in SHARES
            ]
        )
    )
    return (
        rows.select("bad", cells.alias("cell"))
        .groupBy("cell.feature", "cell.threshold")
        .agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    )


def best_condition(rows: DataFrame) -> tuple[Condition, int, int] | None:
    """The condition that gains most on ``rows``, with the bad and good rows it covers.

    The gain is that of covering bad rows: their number times the growth of the logarithm
    of their share. Equal gains go to the first feature, to ``>=`` and to the smaller
    threshold. None if no condition gains.
    """
    upto = Window.partitionBy("feature").orderBy("threshold")
    whole = Window.partitionBy("feature")
    below = upto.rowsBetween(Window.unboundedPreceding, -1)
    counted = _cuts(rows).select(
        "feature",
        "threshold",
        F.sum("bad").over(whole).alias("all_bad"),
        F.sum("good").over(whole).alias("all_good"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("bad_below"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("good_below"),
    )
    sides = F.explode(
        F.array(
            F.struct(
                F.lit(True).alias("at_least"),
                (F.col("all_bad") - F.col("bad_below")).alias("bad"),
                (F.col("all_good") - F.col("good_below")).alias("good"),
            ),
            F.struct(
                F.lit(False).alias("at_least"),
                F.col("bad_below").alias("bad"),
                F.col("good_below").alias("good"),
            ),
        )
    )
    share = F.col("all_bad") / (F.col("all_bad") + F.col("all_good"))
    kept = F.col("bad") / (F.col("bad") + F.col("good"))
    gain = F.round(F.col("bad") * (F.log2(kept) - F.log2(share)), 6)
    found = (
        counted.select("*", sides.alias("side"))
        .select("feature", "threshold", "all_bad", "all_good", "side.*")
        .where("bad > 0")
        .withColumn("gain", gain)
        .where("gain > 0")
        .orderBy(F.desc("gain"), "feature", F.desc("at_least"), "threshold")
        .limit(1)
        .collect()
    )
    for r in found:
        return Condition(r["feature"], r["at_least"], r["threshold"]), r["bad"], r["good"]
    return None


def _grown(rows: DataFrame) -> list[Condition]:
    """Conditions added one by one until no good row is covered or none gains."""
    conditions: list[Condition] = []
    covered = rows.where("grow")
    while len(conditions) < MAX_CONDITIONS:
        found = best_condition(covered)
        if found is None:
            break
        condition, _, good = found
        conditions.append(condition)
        covered = covered.where(condition.holds())
        if not good:
            break
    return conditions


def _pruned(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The first conditions that are most precise on the rows kept for pruning, the fewest
    of equally precise ones, with what they cover of all rows."""
    rules = [Rule(tuple(conditions[:n])) for n in range(1, len(conditions) + 1)]
    kinds = {"bad": F.col("bad"), "good": ~F.col("bad")}
    tally = rows.agg(
        *[
            F.count_if(rule.holds() & kind & (part | ~F.col("grow"))).alias(f"{name}_{label}_{n}")
            for n, rule in enumerate(rules)
            for label, kind in kinds.items()
            for name, part in (("all", F.lit(True)), ("prune", F.lit(False)))
        ]
    ).first()

    def worth(n: int) -> tuple[float, int]:
        bad, good = tally[f"prune_bad_{n}"], tally[f"prune_good_{n}"]
        return ((bad - good) / max(bad + good, 1), -n)

    best = max(range(len(rules)), key=worth)
    return Rule(rules[best].conditions, tally[f"all_bad_{best}"], tally[f"all_good_{best}"])


def learn(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> list[Rule]:
    """Rules for bad documents, in order. ``stats`` is ``statistics`` of the documents,
    stored; a rule covers at least ``LEAST_COVER`` bad rows with ``LEAST_PRECISION``."""
    rows = stored(_labelled(stats, labels, id_col, label_col), "labelled")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions = _grown(rows)
        if not conditions:
            break
        rule = _pruned(rows, conditions)
        if rule.bad < LEAST_COVER or rule.bad < LEAST_PRECISION * (rule.bad + rule.good):
            break
        rules.append(rule)
        rows = rows.where(~rule.holds())
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Whether a row of statistics is kept: the first rule that holds rejects it."""
    if not rules:
        return F.lit(True)
    decided = F.when(rules[0].holds(prefix), F.lit(False))
    for rule in rules[1:]:
        decided = decided.when(rule.holds(prefix), F.lit(False))
    return decided.otherwise(F.lit(True))


def base_failed(prefix: str = "") -> Column:
    """Too few words, or too many of them in repeated windows."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row of statistics."""
    return stats.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept, all columns passed through; decided
    where a row is read, nothing is shuffled."""
    name = "s"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    rows = with_statistics(docs, text_col, name)
    kept = ~base_failed(f"{name}.") & verdict(rules, f"{name}.")
    # Generated, or the optimizer would write the statistics out again below each projection.
    return rows.withColumn(name, F.explode(F.array(kept))).where(name).select(docs.columns)
