from collections import defaultdict

from pyspark.sql import functions as F

from lodestrata.llm import frequency

SCHEMA = "scan string, a string, b string, term string, salt int"


def test_against_sets(spark):
    rows = [(f"s{i % 7}" if i % 11 else None, f" T{i % 5} ", None if i % 3 else "hot", "x", 1) for i in range(500)] + [("s1", "", "  ", "x", 1)] * 3
    tokens = frequency.tokens_of_fields(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "scan")
    n, seen = defaultdict(int), defaultdict(set)
    for scan, a, b, *_ in rows:
        for f, v in (("a", a), ("b", b)):
            if v and v.strip():
                n[f, v.strip().lower()] += 1
                seen[f, v.strip().lower()] |= {scan} - {None}
    for salts in (1, 4):
        got = {(r.field, r.term): (r.occurrences, r.records) for r in frequency.term_counts(tokens, salts).collect()}
        assert got == {k: (n[k], len(seen[k])) for k in n}


def test_marks_and_empty_table(spark):
    counts = spark.createDataFrame([("f", "r", 9, 2), ("f", "m", 9, 5), ("f", "c", 9, 6)], "field string, term string, occurrences long, records long")
    total = spark.createDataFrame([(10,)], "n long").agg(F.max("n"))
    assert {r.term: r.mark for r in frequency.marked(counts, total).collect()} == {"r": "rare", "m": None, "c": "common"}
    empty = spark.createDataFrame([], SCHEMA)
    assert frequency.term_counts(frequency.tokens_of_fields(empty, ["a"], "scan")).count() == 0


def test_words_of_text(spark):
    df = spark.createDataFrame([(1, "A b, a"), (2, None), (3, "b"), (3, "b")], "id int, text string")
    got = {(r.term, r.occurrences, r.records) for r in frequency.term_counts(frequency.tokens_of_text(df, "text", "id")).collect()}
    assert got == {("a", 2, 1), ("b", 3, 2)}


def test_a_record_of_several_tasks_counts_once(spark):
    """A hot term in a hot record, spread over many tasks: every task passes on its own part of it."""
    df = spark.createDataFrame([("s1", "hot")] * 900 + [("s2", "hot"), (None, "hot"), ("s2", "cold")], "scan string, a string").repartition(16)
    got = {(r.term, r.occurrences, r.records) for r in frequency.term_counts(frequency.tokens_of_fields(df, ["a"], "scan"), 3).collect()}
    assert got == {("hot", 902, 2), ("cold", 1, 1)}
