"""Quality rules: a table of thresholds, compiled into one projection.

Each rule names a measure of the text, the values it allows and the number of words
from which on it applies. The measures (words, symbols, stop words, lines, repeated
runs of words) and the verdicts are columns of the same scan: no user function, no
shuffle, and no row looks at another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words stand between these characters: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
BULLETS = r"^[\x20\x09]*[-•*‣▪·]\x20"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09\x0D]*$"
WINDOW = 5

# Frequent function words of English, French, German and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in is that it for was with as be on by at this are an a or from his her not but have which "
    "de la le et les des en un une du que est pour qui dans au par plus avec il ne se sur pas "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del con su para al lo como más"
).split()
# What a stop word may be followed or enclosed by.
MARKS = ".,;:()\"'"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high] in texts of ``words`` words or more."""

    name: str
    measure: str
    low: float | None
    high: float | None
    words: int = 0


RULES = (
    Rule("few_words", "n_words", 10, None),
    Rule("repeated_words", "repeat_percent", None, 20),
    Rule("word_length", "mean_word", 2.0, 15.0, 20),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.04, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)
BASE_RULES = ("few_words", "repeated_words")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a transform over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window which the array holds twice or more.

    Windows are compared by a 64-bit number of their words.
    """
    none = F.lit(0).cast("bigint")

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - p, F.lit(window))))
        return F.aggregate(gaps, none, lambda total, gap: total + gap)

    def starts_of(runs: Column) -> Column:
        """Places of the runs that are not the only ones of their number; equal ones are neighbours here."""
        return F.filter(
            runs,
            lambda run, i: F.coalesce(F.get(runs, i - 1)["run"] == run["run"], F.lit(False))
            | F.coalesce(F.get(runs, i + 1)["run"] == run["run"], F.lit(False)),
        )

    def counted(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda run, i: F.struct(run.alias("run"), i.alias("place"))))
        places = once(placed, lambda p: F.sort_array(F.transform(starts_of(p), lambda run: run["place"])))
        # Most texts repeat nothing: only the others are sorted.
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), none).otherwise(once(places, covered))

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(window)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, none).otherwise(once(hashed, lambda h: once(windows(h), counted)))


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the counts and ratios that rules may name.

    Counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_stop_words``, ``n_lines``
    (with a word), ``n_dup_lines``, ``n_bullets``, ``n_ellipses``,
    ``n_repeat_words``; ratios: ``mean_word``, ``symbol_ratio``, ``stop_ratio``,
    ``dup_line_ratio``, ``bullet_ratio``, ``ellipsis_ratio``, ``repeat_percent``.
    Columns of these names are replaced. A NULL text has no word; ratios of nothing
    are 0.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in MEASURES]
    cut = documents.select(
        *kept,
        F.filter(F.split(body, GAPS), lambda w: w != "").alias("words "),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("lines "),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
    )
    words, lines = F.col("`words `"), F.col("`lines `")
    stop = F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(STOP_WORDS))
    counted = cut.select(
        *kept,
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size(stop).cast("bigint").alias("n_stop_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda line: line.rlike(BULLETS))).cast("bigint").alias("n_bullets"),
        F.size(F.filter(lines, lambda line: line.rlike(ELLIPSIS))).cast("bigint").alias("n_ellipses"),
        repeated_words(words).alias("n_repeat_words"),
    )
    return counted.withColumns(
        {
            "mean_word": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "n_words"),
            "stop_ratio": _ratio("n_stop_words", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "bullet_ratio": _ratio("n_bullets", "n_lines"),
            "ellipsis_ratio": _ratio("n_ellipses", "n_lines"),
            "repeat_percent": _ratio(F.col("n_repeat_words") * 100, "n_words"),
        }
    )


MEASURES = (
    "n_words word_chars n_symbols n_stop_words n_lines n_dup_lines n_bullets n_ellipses n_repeat_words "
    "mean_word symbol_ratio stop_ratio dup_line_ratio bullet_ratio ellipsis_ratio repeat_percent"
).split()


def _ratio(part: Column | str, whole: str) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.coalesce(F.try_divide(part.cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def broken(rule: Rule) -> Column:
    """Whether a measured text breaks the rule; never NULL."""
    value = F.col(rule.measure)
    outside = [value < rule.low] if rule.low is not None else []
    outside += [value > rule.high] if rule.high is not None else []
    wrong = reduce(lambda a, b: a | b, outside, F.lit(False))
    return wrong & (F.col("n_words") >= rule.words) if rule.words else wrong


def judge(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE_RULES) -> DataFrame:
    """The documents with their measures, ``failed`` (names of broken rules), ``base_failed`` and ``kept``.

    A text is kept if it breaks no rule of the table; ``base_failed`` tells whether
    it breaks one of ``base``. All rows stay, and all columns but those whose names
    are given to new ones. NULL and empty texts have no words and fail for it; equal
    rows get equal verdicts; an empty table gives no rows. The key is not looked at
    and may be NULL or repeat. A text of any length is read whole.
    """
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("failed", "base_failed", "kept")]
    found = measured(documents.select(*kept), text)
    names = F.filter(F.array(*[F.when(broken(rule), rule.name) for rule in rules]), lambda name: name.isNotNull())
    marked = found.withColumn("failed", names)
    fails = F.arrays_overlap(F.col("failed"), F.array(*[F.lit(name) for name in base])) if base else F.lit(False)
    return marked.withColumn("base_failed", fails).withColumn("kept", F.size("failed") == 0)


def keep_good(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with the columns they came with."""
    numbered = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.toDF(*numbered)
    names = {c: F.col(n).alias(c) for c, n in zip(documents.columns, numbered)}
    body = numbered[documents.columns.index(text)]
    return judge(plain, body, rules).where("kept").select(*names.values())
