"""Benchmark items that are short or mostly numbers, names and units."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate

BENCH = [
    (1, "Anna gave Ben 3 km"),
    (2, "What is 345 + 678 - 12 * 7?"),
    (3, "Is it so?"),
    (4, "今天天气怎么样？"),
    (5, "Carl has 5 apples and Dora has 9 Jonathans, Carl sells 2 apples to Dora"),
    (6, "1 2 3 4 5 6 7 8 9"),
    (7, "..."),
]
DOCS = [
    (1, "Then Anna gave Ben 3 km of it."),
    (2, "Then Eva gave Tom 7 miles of it."),
    (3, "Q: what is 345 + 678 - 12 * 7? A: none"),
    (4, "Q: what is 346 + 678 - 12 * 7? A: none"),
    (5, "Yes. Is it so? No"),
    (6, "He asked is it so or not"),
    (7, "问题：今天天气怎么样？很好"),
    (8, "x Hans has 50 apples and Maria has 90 Jonathans, Hans sells 20 apples to Maria"),
    (9, "x Hans has 50 apples and Maria has 90 Jonathans, Maria sells 20 apples to Hans"),
    (10, "0 1 2 3 4 5 6 7 8 0"),
    (11, "11 12 13 14 15 16 17 18 19 20"),
]


def duck_leaks(docs, bench):
    """The registered SQL over literal rows."""
    import duckdb

    from gridloom.llm.queries import ORACLES

    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return sorted(con.execute(f"SELECT doc_id, item_id, n_windows, coverage FROM ({ORACLES['op10_decontaminate']})").fetchall(), key=repr)


def test_short_and_slot_heavy_items(spark, monkeypatch):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(BENCH, "item_id long, text string")
    for most in (decontaminate.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        rows = decontaminate.contamination(docs, bench).collect()
        got = {(r.doc_id, r.item_id): r.coverage for r in rows}
        assert sorted(map(tuple, rows), key=repr) == duck_leaks(DOCS, BENCH)
        assert set(got) == {(1, 1), (3, 2), (4, 2), (5, 3), (7, 4), (8, 5), (10, 6)}
        assert got[1, 1] == got[3, 2] == 1 and got[10, 6] == 0.5


def test_items_that_share_an_id_keep_each_slot_pattern(spark):
    ends = ["gave the old red boat to", "before they all went home again"]
    texts = [f"so {a} {ends[0]} {b} {ends[1]}" for a, b in (("Anna", "Ben"), ("Eva", "Eva"))]
    docs = spark.createDataFrame([(1, f"x so Tom {ends[0]} Lars {ends[1]}"), (2, f"x so Tom {ends[0]} Tom {ends[1]}")], "doc_id long, text string")
    for item in (1, None):
        bench = spark.createDataFrame([(item, t) for t in texts], "item_id long, text string")
        wide = {r.doc_id: r.n_windows for r in decontaminate.contamination(docs, bench).collect()}
        assert set(wide) == {1, 2} and wide[1] == wide[2]
        windows = decontaminate.item_windows(bench, "item_id", "text", 8)
        assert windows.where("size(array_distinct(slots)) <> size(slots)").count() > 0 and windows.where("size(slots) = 2 and size(array_distinct(slots)) = 2").count() > 0


QUESTIONS = [
    "{n} gave {m} {a} apples and kept {b} for the trip, so how many apples did {n} have before that?",
    "A train leaves {p} at {a} and reaches {q} after {b} hours; what was its mean speed on the way?",
    "What is the sum of {a} and {b} if {a} is taken twice and {b} is taken away once?",
    "{n} walks {a} km on each of {b} days and then rests, so how far has {n} walked in all?",
    "If a box holds {a} kg of rice and {m} takes {b} kg away, how much rice is left in it?",
    "{n} is {a} years older than {m}, and in {b} years {n} will be twice as old as {m} is then.",
    "The shop of {n} sells {a} litres of milk on every day of the week but sells {b} litres on days with rain.",
    "How many of the {a} pupils in the class of {n} from {p} can read if {b} of them can't read yet?",
]
FILLERS = [("Anna", "Ben", "3", "7", "Paris", "Rome"), ("Mary Ann", "Tom", "seven", "12,000", "New York", "Oslo"), ("Lars", "Eva Maria Holm", "twenty five", "3.5", "Lima", "San Juan"), ("Ömer", "Zoë", "1,250", "nine", "Köln", "Bad Ems")]


def filled_in(question, n, m, a, b, p, q):
    return question.format(n=n, m=m, a=a, b=b, p=p, q=q)


def test_questions_asked_with_other_values_are_found(spark):
    """Recall over planted questions with other names, numbers and units' values; the same texts with their slots confused are left alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    around = lambda: " ".join(word() for _ in range(30))
    bench = [(i, filled_in(q, *FILLERS[0])) for i, q in enumerate(QUESTIONS)]
    planted = [(100 * k + i, f"{around()}. {filled_in(q, *f)} {around()}") for k, f in enumerate(FILLERS) for i, q in enumerate(QUESTIONS)]
    clean = [(1000 + i, around()) for i in range(40)]
    docs = planted + clean
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == duck_leaks(docs, bench)
    found = {(d, i) for d, i, *_ in rows}
    want = {(d, d % 100) for d, _ in planted}
    assert len(found & want) >= 0.9 * len(want) and not any(d >= 1000 for d, _ in found)


#: Benchmark items of four kinds, each as a pattern for values.
KINDS = {
    "names at starts": [
        "{n} has {a} apples. {m} has {b} pears. {o} has {c} plums. {r} has {d} figs.",
        "{n} lives in {p}. {m} went to {q} with {o} for {a} days. {r} stayed at home.",
        "{n} sold {a} boats to {m}. {o} sold {b} boats to {r}.",
    ],
    "short questions": ["What is the capital of {p}?", "How far is it from {p} to {q}?", "Who was the mother of {n}?", "How many days has {n} worked?"],
    "pure arithmetic": ["What is {a} + {b} - {c} * {d}?", "Compute {a} * {b} + {c} / {d} and {b} - {d}.", "Is {a} + {b} more than {c} - {d}?"],
    "mixed": [*QUESTIONS[:4], "{n} pays {a} euros. How much is {b} times {a} euros for {m}?"],
}
VALUES = [
    dict(n="Anna", m="Ben", o="Carl", r="Dora", a="345", b="678", c="12", d="7", p="Peru", q="Chile"),
    dict(n="Max", m="Lena", o="Udo", r="Ida", a="911", b="222", c="10", d="3", p="France", q="Spain"),
    dict(n="Mary Ann", m="Tom", o="Zoe", r="Olaf", a="4,500", b="twenty one", c="six", d="3.5", p="New Zealand", q="Oslo"),
]


@pytest.mark.parametrize("kind", KINDS)
def test_recall_by_kind(spark, kind):
    """Items asked with other values, each a clause or sentences of its own within other text; the same items with two values made one are no match for it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    around = lambda: " ".join(word() for _ in range(30))
    bench = [(i, q.format(**VALUES[0])) for i, q in enumerate(KINDS[kind])]
    planted = [(100 * k + i, f"{around()}. {q.format(**v)} {around()}") for k, v in enumerate(VALUES) for i, q in enumerate(KINDS[kind])]
    confused = [(1000 + i, f"{around()}. {q.format(**VALUES[1] | {'m': 'Max', 'o': 'Max', 'r': 'Max', 'b': '911', 'q': 'France'})} {around()}") for i, q in enumerate(KINDS[kind]) if sum(x in q for x in ("{n}", "{m}", "{o}", "{r}")) > 1 or "{b}" in q or "{q}" in q]
    docs = planted + confused + [(2000 + i, around()) for i in range(10)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == duck_leaks(docs, bench)
    found, want = {(d, i) for d, i, *_ in rows}, {(d, d % 100) for d, _ in planted}
    print(f"{kind}: {len(found & want)} of {len(want)} found, {sum(1000 <= d < 2000 for d, _ in found)} of {len(confused)} confused ones")
    assert len(found & want) >= 0.9 * len(want)
    assert not any(d >= (2000 if kind == "mixed" else 1000) for d, _ in found)  # of long items windows without the confused values still match


def test_a_template_clause_is_met_by_whole_clauses_only(spark):
    bench = [(1, "What is 345 + 678 - 12 * 7?")]
    docs = [(1, "So: what is 1 + 2 - 3 * 4; well"), (2, "So what is 1 + 2 - 3 * 4"), (3, "What is 1 + 2 - 3 * 4 then?"), (4, "What is 1 + 2 - 1 * 4?"), (5, "What is 11 + 22 - 33 * 44"), (6, "x\nWhat is 1 2 3 4\ny")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 5, 6]
    assert sorted(map(tuple, got), key=repr) == duck_leaks(docs, bench)


def test_runs_of_names_and_number_words_are_one_slot(spark):
    row = spark.createDataFrame([("We saw New York City and 3,000.5 km of it. Twenty-five miles, THREE feet, one İnch; McX 12:30pm",)], "t string").select(decontaminate._flat(decontaminate.with_starts(decontaminate.parted(F.col("t")), "words")).alias("s")).select(decontaminate._tokens(F.col("s")).alias("k"), decontaminate._canonical(F.col("s")).alias("w")).first()
    name, number, unit, end, point = (getattr(decontaminate, n) for n in ("NAME", "NUMBER", "UNIT", "END", "POINT"))
    assert row.k[2] == f"{name}new  york  city{end}" and row.k[4] == f"{number}3{point}000{point}5{end}" and f"{number}twenty  five{end}" in row.k
    assert row.w[:8] == ["we", "saw", name, "and", number, unit, "of", "it"] and row.w[8:12] == [number, unit, number, unit] and "mcx" in row.w


def test_items_without_a_word_are_told(spark):
    bench = spark.createDataFrame([(1, "..."), (2, None), (3, "word"), (4, "7")], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.unsearchable(bench).collect()) == [1, 2]


def test_texts_go_by_themselves(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(5, "pad " + item, 1), (5, "a clean text", 2), (None, item, 3), (None, "clean", 4), (6, None, 5)], "doc_id long, text string, th int")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.th for r in kept.collect()) == [2, 4, 5]


def test_long_runs_of_marks_take_linear_time(spark):
    text = "." * 200_000 + "7" + "! " * 100_000 + "\n" * 200_000 + "1.2" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "ten " * 100_000)], "doc_id long, text string")
    assert decontaminate.contamination(docs, spark.createDataFrame([(1, "the quick brown fox jumps over it")], "item_id long, text string")).count() == 0
