import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import matching

LIST = [
    ("license", "Harrowgate-1.0", "Harrowgate Public License 1.0"), ("license", "Harrowgate-2.0", "Harrowgate Public License 2.0"),
    ("license", "MFL-3.1", "Marrowind Free License 3.1"), ("license", "Tamarisk-2-Clause", "Tamarisk 2-Clause License"),
    ("license", "Tamarisk-3-Clause", "Tamarisk 3-Clause License"), ("license", "Glimmerstone-3.0-only", "Glimmerstone General License v3.0 only"),
    ("license", "Glimmerstone-3.0-or-later", "Glimmerstone General License v3.0 or later"), ("policy_category", "sast", "Static application security testing"),
    ("policy_category", "container_images", "Container images"),
]
CASES = {
    "Harrowgate Public Licence v2": "Harrowgate-2.0", "ＨＡＲＲＯＷＧＡＴＥ－１．０": "Harrowgate-1.0", "Harorwgate_1.0": "Harrowgate-1.0", "Harrowgate Public License": "unmatched",
    "Harrowgate-7.1": "unmatched", "marrowind free license": "MFL-3.1", "MFLv3.1": "MFL-3.1", "M.F.L. 3.1": "MFL-3.1", "all rights reserved": "unmatched",
    "License three clause (Tamarisk)": "Tamarisk-3-Clause", "tamarisk 2-cl. lic.": "Tamarisk-2-Clause", "http://lists.example/text/Harrowgate-2_0": "Harrowgate-2.0",
    "Glimmerstone General License >=3.0": "Glimmerstone-3.0-or-later", "glimmerstone 3.0, no later version": "Glimmerstone-3.0-only",
    "Glimmerstone General License version 3.0 or any later version": "Glimmerstone-3.0-or-later", "Plumwhistle Open License 1.0": "unmatched", "-": "unmatched",
    "Hárrowgate Public License, Version 1.0 (see LICENSE)": "Harrowgate-1.0", "x" * 5000: "unmatched",
}
CATEGORIES = {"S.A.S.T.": "sast", "stati ccode analysis, please": "sast", "contianer_images": "container_images", "image": "container_images", "any": "unmatched", "MISC": "unmatched", "Docker container images": "container_images"}


def entries(spark, rows=LIST):
    return spark.createDataFrame(rows, "vocabulary string, canonical string, label string")


def test_values(spark):
    values = [("license", v) for v in CASES] + [("policy_category", v) for v in CATEGORIES]
    got = {(r.vocabulary, r.value): r.canonical for r in matching.match_values(spark.createDataFrame(values, "vocabulary string, value string"), entries(spark)).collect()}
    assert got == {("license", k): v for k, v in CASES.items()} | {("policy_category", k): v for k, v in CATEGORIES.items()}


def test_rows_nulls_literals_and_repeats(spark):
    rows = [("raw", 1, "license", None, "x"), ("raw", 2, "license", " \t", "x"), ("raw", 3, "license", "MFL-3.1", "x"), ("raw", 4, "license", " MFL-3.1 ", "x"), ("raw", 4, "license", " MFL-3.1 ", "x")]
    df = spark.createDataFrame(rows, "field string, record_id long, vocabulary string, value string, name string")
    assert [tuple(r) for r in matching.map_to_canonical(df, entries(spark)).collect()] == [("raw", 4, "MFL-3.1")]
    assert matching.map_to_canonical(df.limit(0), entries(spark)).count() == 0
    assert [r.canonical for r in matching.map_to_canonical(df, entries(spark, LIST).limit(0)).collect()] == ["unmatched"] * 2


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9)))
    left, right = {word() for _ in range(60)}, {word() for _ in range(40)}
    frame = lambda names, col: spark.createDataFrame([("g", n, matching.tokens(n)) for n in sorted(names)], f"vocabulary string, {col} string, tokens array<string>")
    got = {(r.name, r.form): round(r.similarity, 9) for r in matching.similarity_join(frame(left, "name"), frame(right, "form"), ["vocabulary"], F.lit(threshold)).collect()}
    want = {}
    for a in left:
        for b in right:
            x, y = set(matching.tokens(a)), set(matching.tokens(b))
            if len(x & y) / len(x | y) >= threshold:
                want[a, b] = round(len(x & y) / len(x | y), 9)
    assert got == want
