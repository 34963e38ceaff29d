"""Mapping freely typed values to the entries of a reference list.

A prefix-filter set-similarity join. Names are sets of letter tokens; tokens are ordered by global
rarity; only the rarest tokens of a set (its prefix) are joined, which loses no pair that reaches
the threshold; pairs whose lengths or positions rule the threshold out are dropped; the Jaccard
similarity of the rest is verified exactly and the best form is kept. An exact check of what the
value says about version and terms then picks the entry among those that share the form.

Everything runs on distinct values and distinct names, so a value that fills a third of all rows is
matched once; the result goes back to the rows in a join that treats such values apart.

What similarity can't tell, that `static analysis` means `sast`, is an input: a table of other words
(vocabulary, canonical, form), by default the list `CATEGORY_FORMS`.

Defined results: a null or blank value, or one that is literally an entry, is no case; a value that
resembles no form, that names a version the list lacks, or that leaves several entries open is
`unmatched`; ties go to the greater similarity, then to the first form in order; repeated rows give
the same result; an empty reference list leaves everything unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestrata.functions.text import trimmed
from lodestrata.operators.joins import BROADCAST_ROWS, lookup, partitions_of
from lodestrata.storage import Workspace

# Words around a licence's name that never tell one licence from another.
COMMON_WORDS = frozenset(
    """license licence lic licenca licencia lizenz licenses licenseref licensed released under the terms of see file vendored spdx identifier
    version ver only later or any no newer clause cl two three four http https www html txt text lists example com org
    all rights reserved proprietary commercial contract internal use personal free for unknown custom none noassertion ask legal
    dual check readme copying tba todo public open source""".split()
)
# Number words before "clause".
NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5"}
# Other words for the entries of the policy categories.
CATEGORY_FORMS = {
    "secrets": "secrets, secret, secret detection, secret scan, secrets scanning, hardcoded secrets, leaked secrets, secrets in source code, credentials",
    "sast": "sast, sast scan, sast scanning, sast findings, static analysis, static code analysis, static app security testing",
    "iac": "iac, iac scan, iac misconfiguration, infrastructure as code, infra as code, infra as code checks, infrastructure code",
    "cve": "cve, cves, cve scan, known vulns, known vulnerabilities, known vulnerability cve, vulnerabilities",
    "dependency_scanning": "dependency scanning, dependency scan, dependencies, deps scanning, dependency check scanning, scanning of dependencies",
    "container_images": "container images, container image, containers, container, image, images, container scanning, image scanning, docker container images, images container",
}
# Words around a category that say nothing.
CATEGORY_NOISE = frozenset("please rule gate category".split())

THRESHOLD = {"license": 0.31, "policy_category": 0.42}
#: A licence's name without any version must be nearer than this.
NAME_ALONE = 0.4
#: Names up to this length (acronyms) must be equal.
SHORT = 4


def folded(value: str) -> str:
    """Compatibility forms, accents and letter case folded away."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value))
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold()


def tokens(name: str) -> list[str]:
    """Neighbouring letters, letters around a gap, and counted letters, as a set."""
    framed, seen, out = f"^{name}$", Counter(), set()
    for i in range(len(framed) - 1):
        out.add(framed[i : i + 2])
        if i + 2 < len(framed):
            out.add(f"{framed[i]}_{framed[i + 2]}")
    for c in name:
        seen[c] += 1
        out.add(f"{c}{seen[c]}")
    return sorted(out)


def license_parts(value: str) -> tuple[list[str], str, str]:
    """(words that may name the licence, version, terms) of a value."""
    text = re.sub(r"(?<=[a-z])v(?=[.\s]*\d)", " ", folded(value))
    words, letters = [], ""
    for w in [*re.findall(r"[^\W\d_]+", text), ""]:
        if len(w) == 1:
            letters += w
            continue
        if len(letters) > 1:
            words.append(letters)
        letters = ""
        if w and w not in COMMON_WORDS:
            words.append(w)
    clause = re.search(r"(\d+|" + "|".join(NUMBERS) + r")[\W_]*(?:clause|cl\b)", text)
    number = re.search(r"\d+(?:[._]\d+)*", text)
    if clause:
        return words, NUMBERS.get(clause[1], clause[1]), "clause"
    version = re.sub(r"(\.0+)+$", "", number[0].replace("_", ".")) if number else ""
    if re.search(r"no\s+later|\bonly\b|\bonly$", text.replace("_", " ")):
        terms = "only"
    else:
        terms = "later" if re.search(r"later|newer|\d\s*\+|>=", text) else ""
    return words, version, terms


def category_parts(value: str) -> tuple[list[str], str, str]:
    """The whole value is one name; how it is cut into words does not matter."""
    words = [w for w in re.findall(r"[^\W_]+", folded(value)) if w not in CATEGORY_NOISE]
    return (["".join(words)] if words else []), "", ""


PARTS = {"license": license_parts, "policy_category": category_parts}
_PARTS = StructType([StructField("names", ArrayType(StringType())), StructField("version", StringType()), StructField("terms", StringType())])


@F.pandas_udf(_PARTS)
def _parts(vocabulary: pd.Series, value: pd.Series) -> pd.DataFrame:
    rows = [PARTS[v](x) for v, x in zip(vocabulary, value)]
    return pd.DataFrame([(sorted(set(n)), v, t) for n, v, t in rows], columns=["names", "version", "terms"])


@F.pandas_udf(ArrayType(StringType()))
def _tokens(name: pd.Series) -> pd.Series:
    return name.map(tokens)


def _reference_rows(vocabulary: str, canonical: str, label: str) -> list[tuple[str, str, str]]:
    """(form, version, terms) of one entry."""
    if vocabulary == "license":
        _, version, terms = license_parts(canonical)
        return [(re.split(r"[\W\d_]", folded(x))[0], version, terms) for x in (canonical, label)]
    return [(n, "", "") for f in {canonical, label} for n in category_parts(f)[0]]


_FORMS = ArrayType(StructType([StructField(c, StringType()) for c in ("form", "version", "terms")]))


@F.pandas_udf(_FORMS)
def _entry_forms(vocabulary: pd.Series, canonical: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(_reference_rows(v, c, x or c))) for v, c, x in zip(vocabulary, canonical, label)])


def other_words(spark: SparkSession) -> DataFrame:
    """(vocabulary, canonical, form): the default list of other words for the entries."""
    return spark.createDataFrame([("policy_category", c, f) for c, forms in CATEGORY_FORMS.items() for f in forms.split(", ")], "vocabulary string, canonical string, form string")


def reference_forms(canonical_values: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(vocabulary, canonical, form, version, terms): every form under which an entry is known.

    `words`: (vocabulary, canonical, form) of other words; those for entries that the list lacks are passed over.
    """
    rows = canonical_values.where(F.col("vocabulary").isin(*PARTS) & F.col("canonical").isNotNull()).select("vocabulary", "canonical", "label")
    words = other_words(canonical_values.sparkSession) if words is None else words
    more = words.select("vocabulary", "canonical", F.col("form").alias("label")).join(rows, ["vocabulary", "canonical"], "left_semi")
    rows = rows.unionByName(more)
    rows = rows.select("vocabulary", "canonical", F.explode(_entry_forms("vocabulary", "canonical", "label")).alias("_f"))
    return rows.select("vocabulary", "canonical", "_f.*").where("form <> ''").distinct()


def similarity_join(left: DataFrame, right: DataFrame, groups: list[str], threshold: Column) -> DataFrame:
    """(groups, name, form, similarity) of all pairs of token sets that reach the threshold.

    `left`: (groups, name, tokens), `right`: (groups, form, tokens), both distinct and written; `threshold` may
    read the groups. No cap on candidates: a pair is dropped only where the filters prove it too far.
    Candidates are pairs of ids; the token sets are fetched for verification once a pair. Names are
    spread by name over all partitions before they meet the forms, which are broadcast after a check of their rows.
    """
    both = left.select(*groups, F.lit(0).alias("side"), F.col("name").alias("id"), "tokens").unionByName(
        right.select(*groups, F.lit(1).alias("side"), F.col("form").alias("id"), "tokens")
    )
    each = both.select(*groups, "side", "id", F.explode("tokens").alias("token"))
    rarity = each.groupBy(*groups, "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        each.join(rarity, [*groups, "token"])
        .groupBy(*groups, "side", "id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))  # a name's own tokens
        .select(*groups, "side", "id", F.col("t.token").alias("tokens"), F.size("t").alias("size"), threshold.alias("least"))
    )
    prefix = F.slice("tokens", F.lit(1), (F.col("size") - F.ceil(F.col("least") * F.col("size")) + 1).cast("int"))
    work = Workspace(left.sparkSession, "similar")
    rare = work.cut(ordered.select(*groups, "side", "id", "size", "least", prefix.alias("prefix")), "prefixes")
    side = lambda n, p: rare.where(F.col("side") == n).select(*groups, "least", F.col("id").alias(f"{p}_id"), F.col("size").alias(f"{p}_size"), "prefix")
    names = side(0, "a").repartition(partitions_of(left), *groups, "a_id").select("*", F.posexplode("prefix").alias("a_at", "token")).drop("prefix")
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = lambda df: F.broadcast(df) if few else df
    forms = sized(side(1, "b").select(*groups, "b_id", "b_size", F.posexplode("prefix").alias("b_at", "token")))
    t, x, y = F.col("least"), F.col("a_size"), F.col("b_size")
    needed = F.ceil(t / (t + 1) * (x + y) - F.lit(1e-9))
    near = names.join(forms, [*groups, "token"]).where(
        (y >= t * x) & (x >= t * y) & (1 + F.least(x - F.col("a_at") - 1, y - F.col("b_at") - 1) >= needed - F.least("a_at", "b_at"))
    )
    pairs = near.select(*groups, "a_id", "b_id", "least").dropDuplicates([*groups, "a_id", "b_id"])
    met = pairs.join(left.select(*groups, F.col("name").alias("a_id"), F.col("tokens").alias("a")), [*groups, "a_id"])
    met = met.join(sized(right.select(*groups, F.col("form").alias("b_id"), F.col("tokens").alias("b"))), [*groups, "b_id"])
    shared = F.size(F.array_intersect("a", "b"))
    similarity = shared / (F.size("a") + F.size("b") - shared)
    return met.select(*groups, F.col("a_id").alias("name"), F.col("b_id").alias("form"), similarity.alias("similarity"), "least").where("similarity >= least").drop("least")


def match_values(values: DataFrame, canonical_values: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(vocabulary, value, canonical) of distinct (vocabulary, value): the entry meant, or unmatched."""
    group = ["vocabulary"]
    work = Workspace(values.sparkSession, "matching")
    parsed = values.select("vocabulary", "value", _parts("vocabulary", "value").alias("_p")).select("vocabulary", "value", "_p.*")
    # written, as several branches read them and Python must see each value once
    parsed, forms = work.cut(parsed, "parsed"), work.cut(reference_forms(canonical_values, words), "forms")
    named = parsed.select("vocabulary", "value", F.explode("names").alias("name"))
    names = named.select("vocabulary", "name").distinct().withColumn("tokens", _tokens("name"))
    form_sets = forms.select("vocabulary", "form").distinct().withColumn("tokens", _tokens("form"))
    least = F.lit(1.0)
    for vocabulary, t in THRESHOLD.items():
        least = F.when(F.col("vocabulary") == vocabulary, t).otherwise(least)
    similar = similarity_join(work.cut(names, "names"), work.cut(form_sets, "form_sets"), group, least)
    # an acronym is never misspelled into another word
    similar = similar.where((F.col("vocabulary") != "license") | (F.length("form") > SHORT) | (F.col("similarity") == 1))
    best = (
        named.join(similar, ["vocabulary", "name"])
        .groupBy("vocabulary", "value")
        .agg(F.min(F.struct((-F.col("similarity")).alias("far"), F.col("form"))).alias("_b"))
        .select("vocabulary", "value", F.col("_b.form").alias("form"), (-F.col("_b.far")).alias("similarity"))
    )
    entry = forms.withColumnsRenamed({"version": "has_version", "terms": "has_terms"})
    said = best.join(parsed.drop("names"), ["vocabulary", "value"]).join(entry, ["vocabulary", "form"])
    no_version = F.col("version") == ""
    same = F.when(no_version, F.col("similarity") >= F.when(F.col("vocabulary") == "license", NAME_ALONE).otherwise(0.0)).otherwise(
        F.col("version") == F.col("has_version")
    ) & ((F.col("terms") == F.col("has_terms")) | (F.col("has_terms") == "") | (F.col("terms") == ""))
    chosen = (
        said.where(same)
        .groupBy("vocabulary", "value")
        .agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"))
        .where("canonical = _other")
        .drop("_other")
    )
    return parsed.select("vocabulary", "value").join(chosen, ["vocabulary", "value"], "left").select("vocabulary", "value", F.coalesce("canonical", F.lit("unmatched")).alias("canonical"))


def map_to_canonical(rows: DataFrame, canonical_values: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(field, record_id, canonical) of every case among (field, record_id, vocabulary, value) rows."""
    work = Workspace(rows.sparkSession, "canonical")
    literal = canonical_values.select("vocabulary", F.col("canonical").alias("value"))
    cases = work.cut(rows.select("field", "record_id", "vocabulary", "value").where(trimmed("value") != "").join(literal, ["vocabulary", "value"], "left_anti"), "cases")
    matched = work.cut(match_values(cases.select("vocabulary", "value").distinct(), canonical_values, words), "matched")
    return lookup(cases, matched, ["vocabulary", "value"], written=True).select("field", "record_id", "canonical").distinct()
