"""Secrets in whole texts: fixed forms, and strings of high entropy.

Fixed forms are the kinds ``assign``, ``access`` and ``hex`` (``BASE``). Entropy
adds spans of two more kinds: a candidate is a long run of key characters with a
digit; a window slides over it, and the Shannon entropy of its characters is kept
by counts that change by one character in and one out. The span reaches from the
first window above the limit of the candidate's character class to the last.
Strings that the allow list describes from end to end, and those inside a fixed
form, add nothing.

Only DataFrame functions and no shuffle: every text is read where it lies.
Entropy is compared in whole numbers, so the result has no rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms, in their order, and the least length that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
# A whole run of key characters that has a digit. The look-behind only saves attempts inside short runs.
CANDIDATE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
# Least entropy in bits per character that a window of each class must have.
LIMITS = {"entropy_hex": 3.0, "entropy_mixed": 3.8}
HEX_CLASS = "^[0-9a-fA-F]+$"


def _sequence(symbols: str, least: int) -> str:
    """Pattern of the first ``least`` symbols, and of as many more as follow in their order."""
    return symbols[:least] + "".join(f"(?:{c}" for c in symbols[least:]) + ")?" * (len(symbols) - least)


UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# A word (written small, Capital, CAPITAL or joinedWords) with a short number, or a number with a short ending.
PART = "(?:(?:[A-Z]?[a-z]{1,19}(?:[A-Z][a-z]{2,})*|[A-Z]{1,19})?[0-9]{0,4}|[0-9]+[a-z]{0,2})"
STAND_IN = (
    "example|sample|placeholder|dummy|changeme|test|your|my|api|access|key|secret|token|password|here|[/_+=-]|"
    + "|".join([_sequence("abcdefghijklmnopqrstuvwxyz", 4), _sequence("0123456789", 5), _sequence("1234567890", 4)])
)
# Harmless strings of high entropy: numbers, identifiers of records, words and numbers joined as in paths and names, stand-ins.
# Each pattern describes a whole string: a key beside something harmless is not allowed by it.
ALLOWED = (
    "^[0-9=_-]+$",
    f"^{UUID}$",
    f"^(?:(?:{UUID}|{PART})[/_-]){{0,50}}(?:{UUID}|{PART})$",
    f"(?i)^(?:{STAND_IN}){{1,50}}[0-9]{{0,4}}=*$",
)
KINDS = [*BASE, *LIMITS]

SCALE = 1_000_000
SPAN = "struct<start:bigint,kind:int,end:bigint>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def weight(count: int) -> int:
    """count * log2(count) as a whole number."""
    return round(count * math.log2(count) * SCALE) if count else 0


def most_weight(bits: float) -> int:
    """The largest sum of weights in a window that has at least so much entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> tuple[Column, Column]:
    """Base spans and added spans of a text: arrays of (start, kind, end) in order.

    Positions count code points, ends are exclusive, kinds are positions in
    ``KINDS``. NULL and empty texts have no spans.
    """
    body = F.coalesce(text.cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[_base_spans(body, name) for name in BASE]))
    return base, _entropy_spans(body, allowed)


def _matches(body: Column, pattern: str) -> Column:
    """Start and text of each match, from the lengths of what lies between matches."""
    between = F.split(body, pattern, -1)
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    both = F.filter(
        F.zip_with(between, found, lambda gap, match: F.struct(F.length(gap).cast("bigint").alias("gap"), match.alias("found"))),
        lambda x: x["found"].isNotNull(),
    )
    start = F.expr("named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,found:string>>))")
    placed = F.aggregate(
        both,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["found"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["found"].alias("found")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return placed


def _base_spans(body: Column, name: str) -> Column:
    pattern = BASE[name]
    matches = _matches(body, pattern)
    if name == "assign":
        matches = F.filter(matches, lambda m: F.length(F.regexp_extract(m["found"], pattern, 2)) >= ASSIGN_VALUE)
    shaped = F.transform(
        matches,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), (m["start"] + F.length(m["found"])).alias("end")
        ),
    )
    return F.when(body.rlike(pattern), shaped).otherwise(F.expr(NO_SPANS))


def _entropy_spans(body: Column, allowed: tuple[str, ...]) -> Column:
    def harmless(string: Column) -> Column:
        verdict = F.lit(False)
        for pattern in allowed:
            verdict = verdict | string.rlike(pattern)
        return verdict

    def span(match: Column) -> Column:
        is_hex = match["found"].rlike(HEX_CLASS)
        limit = F.when(is_hex, F.lit(most_weight(LIMITS["entropy_hex"]))).otherwise(F.lit(most_weight(LIMITS["entropy_mixed"])))
        kind = F.when(is_hex, F.lit(KINDS.index("entropy_hex"))).otherwise(F.lit(KINDS.index("entropy_mixed")))

        def placed(reach: Column) -> Column:
            return F.struct(
                (match["start"] + reach["first"]).alias("start"), kind.alias("kind"), (match["start"] + reach["last"]).alias("end")
            )

        return F.element_at(F.transform(F.array(_reach(match["found"], limit)), placed), 1)

    candidates = F.filter(_matches(body, CANDIDATE), lambda m: ~harmless(m["found"]))
    found = F.filter(F.transform(candidates, span), lambda s: s["start"].isNotNull())
    return F.when(body.rlike(CANDIDATE), found).otherwise(F.expr(NO_SPANS))


def _reach(string: Column, limit: Column) -> Column:
    """First and end position of the windows within the limit, NULL if there are none.

    The fold goes over events: a character enters the window, or the one WINDOW
    places before leaves it; each changes one count and the sum of weights.
    """
    symbols = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    weights = F.array(*[F.lit(weight(n)).cast("bigint") for n in range(WINDOW + 2)])

    def events(known: Column, i: Column) -> Column:
        enters = F.struct(F.element_at(known, i).alias("symbol"), F.lit(1).alias("change"), i.alias("end"))
        leaves = F.struct(F.element_at(known, i - WINDOW).alias("symbol"), F.lit(-1).alias("change"), i.alias("end"))
        return F.when(i > WINDOW, F.array(leaves, enters)).otherwise(F.array(enters))

    start = F.struct(
        F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(acc: Column, event: Column) -> Column:
        count = F.get(acc["counts"], event["symbol"])
        total = acc["sum"] - F.get(weights, count) + F.get(weights, count + event["change"])
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == event["symbol"], event["change"]).otherwise(F.lit(0)))
        hit = (event["change"] == 1) & (event["end"] >= WINDOW) & (total <= limit)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hit, F.coalesce(acc["first"], event["end"] - WINDOW)).otherwise(acc["first"]).alias("first"),
            F.when(hit, event["end"]).otherwise(acc["last"]).alias("last"),
        )

    places = F.sequence(F.lit(1), F.length(string))
    # A transform over one element works the symbols out once, not once a place.
    every = F.flatten(F.element_at(F.transform(F.array(symbols), lambda known: F.transform(places, lambda i: events(known, i))), 1))
    return F.aggregate(every, start, step)


def scan(
    documents: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, base_as: str = "base_spans", all_as: str = "spans"
) -> DataFrame:
    """The documents with ``base_spans`` and ``spans`` (base ones and added ones).

    All other columns stay; columns of these two names are replaced. NULL and empty
    texts have empty arrays; repeated rows are each scanned; an empty table gives
    no rows.
    """
    base, added = spans(F.col(text), allowed)
    found = documents.withColumn(base_as, base).withColumn(all_as, added)
    outside = F.filter(
        F.col(all_as), lambda s: ~F.exists(F.col(base_as), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    )
    return found.withColumn(all_as, F.array_sort(F.concat(base_as, outside)))


def count_of(spans_column: str, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans_column, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def written(spans_column: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans_column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(documents: DataFrame, text: str = "text", mask: str = "[SECRET]", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The documents with each span of their text replaced by the mask; all rows and columns stay.

    Spans that overlap become one mask. A NULL text stays NULL.
    """
    # Names with a blank cannot clash with the documents' own columns.
    found = scan(documents.withColumn("text ", F.col(text)), "text ", allowed, "base ", "spans ")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    body = F.col("text ")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    masked = F.aggregate(
        F.col("spans "), start, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))
    )
    whole = F.when(F.size("spans ") > 0, masked).otherwise(body)
    return found.withColumn(text, whole).select(*[F.col(f"`{c}`") for c in documents.columns])
