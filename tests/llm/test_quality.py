import pytest

from lodestrata.llm import quality

PROSE = "The image is built as root and keeps its package cache, which makes it larger. We will fix it in 1.2.3."
CASES = [
    (None, None), ("", None), (" \n\t ", None), (PROSE, "prose"), (PROSE.upper(), "prose"), ("# Notes\n\n" + PROSE + "\n- a-b\n- c-d", "prose"),
    ("Der Hinweis betrifft alle Versionen unter 4.1, daher planen wir eine neue Ausgabe.", "prose"),
    ("Файл ещё не проверен, потому что нет файла блокировки.", "prose"), ("前回の実行はまだ確認されていません", "prose"),
    ("The image is built\nas root and keeps its\npackage cache, which\nmakes it larger.", "prose"), ("Thanks!", "prose"),
    ("- lin-utils\n- zor-cli\n- ADV-2031-1", "list"), ("Open items\n1. a/b.py\n2. c/d.py\n3. Check e-f", "list"), ("[ ] a-b\n[x] c-d\n[ ] e/f.go", "list"),
    ("a-b\nc-d\ne-f\ng-h", "list"), ("To do\na-b, c-d, e/f.py, g@1.2, h-i", "list"), ("* Pin gresk in lib/a.py.\n* Review lin-x in b/c.go.\n* Remove y in d.rb.", "list"),
    ("name,version,score\na-b,1.2,3\nc-d,1.3,4\ne-f,2,5", "table"), ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "table"),
    ("+---+---+\n| a | b |\n+---+---+\n| 1 | 2 |\n+---+---+", "table"), ("<table>\n<tr><td>a</td><td>b</td></tr>\n</table>", "table"),
    ("team   score\noxbow    6.1\nmarlow   1.3\nfathom   2.8", "table"), ("a\tb\tc\n1\t\t3\n4\t5\t6", "table"),
    ("00000000  09 08 68 10 02 ab 6b 66 8e 5a\n00000010  56 80 13 31 4f 1b aa 67 22 5d", "junk"), ("scan\n" * 30, "junk"), ("loading..." * 40, "junk"),
    ("####################\n~~~~~~~~~~~~~~~~~~~~", "junk"), ("qkvgqvxncj gmxclg pmnfaajdhwgm vkanpbv bgcsg clr lmzltlqdl", "junk"),
    ("var hz=e$(726)||function(hz){return ex[8]^0xd6f721};" * 5, "junk"), ("█####......| 59% 807/94 [46:42<?]\n█########..| 96% 854/508 [20:03<?]", "junk"),
    ("m93scBuycVG5tby4ybY0Kw6xSAMov0uY3nOvfHiLUY+IgcIyNAbO\nAAeyz1DOAG9YQNwJpjxKJ29rTllWBah6ljy4sVQs2zuAJNlJopU", "junk"),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_kind(text, kind):
    assert quality.kind_of(text or "")[0] == kind


def test_statistics():
    row = dict(zip([n for n, _ in quality.FIELDS], quality.profile("The cat sat.\n\nThe cat sat.\nx!")))
    assert row["n_words"] == 7 and row["n_lines"] == 3 and row["n_paragraphs"] == 2
    assert row["duplicate_line_share"] == round(1 / 3, 6) and row["punctuated_line_share"] == 1.0
    assert row["mean_word_length"] == round(19 / 7, 6) and row["common_word_share"] == round(2 / 7, 6)
    assert row["top_ngram_share"] == round(18 / 19, 6)


def test_whole_table_with_nulls_and_long_texts(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, (PROSE + "\n") * 20000, "q"), (3, PROSE, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.kind or "", r.n_words) for r in quality.text_quality(df).collect())
    assert [g[:2] for g in got] == [(1, ""), (2, ""), (3, "prose"), (3, "prose")] and got[-1][2] == 20000 * got[-2][2]
    assert quality.text_quality(df.limit(0)).count() == 0


def test_repetition_enters_the_rules():
    assert quality.kind_of("alpha beta gamma " * 40)[0] == "junk"
    assert quality.kind_of("alpha-1 beta.2 gamma_3 " * 30)[0] == "junk"
    footer = "All rights reserved by the owners of this text.\n\n"
    entries = "\n".join(f"- a-{i}/b{i}.py" for i in range(12))
    assert quality.kind_of(footer * 6 + entries)[0] == "list"
    assert quality.kind_of((PROSE + "\n\n") * 50)[0] == "prose"
    said = quality.repetition("x y z\n\nx y z", ["x y z", "x y z"], ["x", "y", "z", "x", "y", "z"])
    assert (said.lines, said.paragraphs, said.top_ngram) == (0.5, 0.5, 1.0)


def test_kinds_alone_are_those_of_the_statistics(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.kind or "") for r in quality.text_kinds(df).collect()) == sorted((r.doc_id, r.kind or "") for r in quality.text_quality(df).collect())
