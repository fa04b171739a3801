"""Quality rules against plain Python."""

import re
from collections import Counter

import pytest

from orderloom.llm import rules
from orderloom.llm.queries import QUERIES

KINDS = "doc_id bigint, text string, kept string, n_words int, `a.b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(runs)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + j for i, run in enumerate(runs) if times[run] > 1 for j in range(5)}),
        "n_stop_words": sum(w.strip(rules.MARKS).lower() in rules.STOP_WORDS for w in words),
    }


PROSE = "The ship was late, and the crew of it had not slept for a day. "
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "one",
    "a b c d e",
    "a b c d e f",
    "a b c d e a b c d e",
    "x " * 30,
    "a a a a a a b c d e f",
    "🙂🙂 é é ü \x1c\x00 ok",
    "same\nsame\n\n \nsame \r\nother",
    "\n".join(f"- item {i}" for i in range(30)),
    "\n".join(f"word number {i} ..." for i in range(30)),
    "## $$ %% && || << >> **",
    "word&&& " * 3 + PROSE,
    PROSE,
    PROSE + "Then it sailed on.",
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(f"w{i}" for i in range(7_000, 7_100)),
    "w1 w2 w3 w4 w5 " * 4_000,
    "y" * 200_000,
]


def test_measures(spark):
    rows = [(i, text, "x", 1, "z") for i, text in enumerate(TEXTS)] + [(None, PROSE, None, None, None), (3, "one", "x", 1, "z")]
    found = rules.judge(spark.createDataFrame(rows, KINDS)).collect()
    assert len(found) == len(rows)
    for row in found:
        text = row["text"]
        want = expected(text)
        assert {name: row[name] for name in want} == want, repr(text)[:80]
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert row["base_failed"] == failed and (not row["kept"] or not failed)
        assert row["kept"] == (not row["failed"]) and row["a.b"] in ("z", None)


@pytest.mark.parametrize(
    ("text", "failed"),
    [
        (PROSE, []),
        (" ".join(f"w{i}" for i in range(60)), ["stop_words"]),
        ("\n".join(f"- the item of {i}" for i in range(30)), ["bullet_lines"]),
        ("\n".join(f"the word of {i} ..." for i in range(30)), ["ellipsis_lines"]),
        ("\n".join(["And so it was"] * 2 + ["of the", "to be", "in the sea"]), []),
        ("\n".join(["And so"] * 3 + ["of the", "to be", "in the sea"]), []),
        ("\n".join(["So"] * 4 + ["of the", "to be", "in the sea"]), ["repeated_lines"]),
        ("a | b | c | d | e | f | g", ["symbols"]),
        (" ".join(f"{'z' * 20}{i}" for i in range(25)), ["word_length"]),
    ],
)
def test_each_rule(spark, text, failed):
    assert rules.judge(spark.createDataFrame([(1, text)], "id int, text string")).first()["failed"] == failed


def test_own_table(spark):
    own = (rules.Rule("long", "n_words", None, 3),)
    table = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, None)], "id int, body string")
    found = {r["id"]: (r["kept"], r["base_failed"]) for r in rules.judge(table, "body", own, ()).collect()}
    assert found == {1: (True, False), 2: (False, False), 3: (True, False)}


def test_keep_good(spark):
    table = spark.createDataFrame([(1, PROSE, "x", 1, "z"), (2, None, "x", 1, "z"), (1, PROSE, "x", 1, "z")], KINDS)
    kept = rules.keep_good(table)
    assert kept.schema == table.schema
    assert [tuple(r) for r in kept.collect()] == [(1, PROSE, "x", 1, "z")] * 2
    assert rules.judge(table.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null")
    found = QUERIES["op13_rules"](spark, folder).join(labels, "doc_id").toPandas()
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    assert not ((good["kept"] == 0) & ~good["base_failed"]).any()
    assert (bad["kept"] == 0).mean() > 0.95


def test_one_projection(spark):
    plan = rules.judge(spark.range(1).selectExpr("id", "'a' as text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Generate", "Join"))
