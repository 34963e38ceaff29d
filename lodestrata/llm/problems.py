"""The pN_ queries of the subpackage's problems, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.llm import frequency, matching, mixing, quality, tokenizer
from lodestrata.storage import Workspace, spread, table

FIELDS = ["rule_id", "severity", "category"]


def _typed_values(spark, d):
    """(field, record_id, vocabulary, value) of all values that are typed freely."""
    licences, rules = table(spark, d, "license_observations"), table(spark, d, "policy_rules")
    row = lambda f, v, i, x: F.struct(F.lit(f).alias("field"), F.col(i).cast("long").alias("record_id"), F.lit(v).alias("vocabulary"), F.col(x).alias("value"))
    one = licences.select(F.inline(F.array(*[row(f, "license", "observation_id", f) for f in ("raw", "expression")])))
    return one.unionByName(rules.select(F.inline(F.array(row("category", "policy_category", "rule_no", "category")))))


def p3_found(spark, d):
    return matching.map_to_canonical(_typed_values(spark, d), table(spark, d, "canonical_values"))


def p3_unmatched(spark, d):
    """How often each value that has no entry was typed."""
    rows = _typed_values(spark, d)
    entries = table(spark, d, "canonical_values")
    values = rows.where("trim(value) <> ''").groupBy("vocabulary", "value").agg(F.count("record_id").alias("n_rows"))
    values = values.join(entries.select("vocabulary", F.col("canonical").alias("value")), ["vocabulary", "value"], "left_anti")
    matched = matching.match_values(values.select("vocabulary", "value"), entries).where("canonical = 'unmatched'")
    return values.join(matched.drop("canonical"), ["vocabulary", "value"])


def p5_counts(spark, d):
    """Every term with its rows, its scans and its mark."""
    findings = table(spark, d, "findings")
    scans = findings.select(F.count_distinct("scan_id").alias("n"))
    return frequency.marked(frequency.term_counts(frequency.tokens_of_fields(findings, FIELDS, "scan_id")), scans)


def p5_found(spark, d):
    return p5_counts(spark, d).where("mark is not null").select("field", "term", "mark")


def p5_words(spark, d):
    """Occurrences and documents of every word of the texts."""
    docs = table(spark, d, "documents")
    return frequency.term_counts(frequency.tokens_of_text(docs, "text", "doc_id"))


def p6_ids(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokenizer.token_ids(F.col("text")).alias("ids"))


def _sources(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")


def p7_mix(spark, d):
    return mixing.mix(_sources(spark, d), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    mixed, shares, _ = mixing.mix(_sources(spark, d), table(spark, d, "mix_targets"))
    return mixing.shares_reached(mixed, shares)


def p7_checks(spark, d):
    """How often the mix breaks its promises: never."""
    mixed, shares, _ = mixing.mix(_sources(spark, d), table(spark, d, "mix_targets"))
    return mixing.broken_promises(Workspace(spark, "mix").cut(mixed, "mix"), shares, mixing.finish_line(shares, None)[0])


def p8_stats(spark, d):
    return quality.text_quality(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def p8_found(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return quality.text_kinds(docs).where("kind in ('list', 'table', 'junk')")


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched, "p5_found": p5_found, "p5_counts": p5_counts, "p5_words": p5_words, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_stats": p8_stats}

_TERMS = r"""
WITH t AS (SELECT scan_id, unnest([{'field': 'rule_id', 'v': rule_id}, {'field': 'severity', 'v': severity}, {'field': 'category', 'v': category}], recursive := true) FROM findings),
k AS (SELECT scan_id, field, lower(trim(v, E' \t\r\n\x0b\x0c')) AS term FROM t),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT scan_id) AS records FROM k WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.5 * (SELECT count(DISTINCT scan_id) FROM findings) THEN 'common' END AS mark FROM c)
"""
ORACLES = {
    "p5_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    "p7_checks": "SELECT unnest(['repeats', 'uses', 'order', 'share']) AS promise, 0::BIGINT AS n",
    "p5_words": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[\p{L}\p{M}\p{N}_]+')) AS term FROM documents)
SELECT 'text' AS field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM w GROUP BY term""",
}
