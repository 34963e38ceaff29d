"""Source trees as rows: listing, content digests, and what changed between two readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestrata.functions.paths import ecosystem_of, package_format

#: Directories that are never part of a source tree.
CONTROL = ["/.git/", "/.hg/", "/.svn/"]


def discover(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """(path, size, sha256, content, format, ecosystem) of the files under a root; paths are relative to it.

    Version-control folders are left out before their content is read. Without content the listing
    alone is made, and no file is opened. The file source passes over files of no bytes.
    """
    root = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace("path", r"^file:/+", "/")
    plain = root.removeprefix("file://")
    listed = files.withColumn("path", F.substring(inside, F.lit(len(plain) + 1), F.length(inside)))
    for c in CONTROL:
        listed = listed.where(~F.concat(F.lit("/"), F.col("path")).contains(c))
    columns = ["path", F.col("length").alias("size")]
    if with_content:
        columns += [F.sha2("content", 256).alias("sha256"), "content"]
    fmt = package_format(F.col("path"))
    return listed.select(*columns, fmt.alias("format"), ecosystem_of(fmt).alias("ecosystem"))


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two readings (path, sha256): added, removed or changed."""
    a, b = before.select("path", F.col("sha256").alias("_a")), after.select("path", F.col("sha256").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def admissible_path(path: Column) -> Column:
    """Whether a path is relative, without empty, `.` or `..` segments, backslashes or control characters, and within bounds."""
    parts = F.split(path, "/")
    good = F.forall(parts, lambda x: ~x.isin("", ".", "..") & (F.octet_length(x) <= 255))
    return F.coalesce((F.octet_length(path) <= 4096) & ~path.rlike(r"[\\\x00-\x1f\x7f]") & good, F.lit(False))


def repository_path(staged: Column, stage: str) -> Column:
    """A path below a staging folder as a path in the repository; null if it leaves the folder."""
    prefix = stage.rstrip("/") + "/"
    inner = F.when(staged.startswith(prefix), F.substring(staged, F.lit(len(prefix) + 1), F.length(staged))).when(~staged.startswith("/"), staged)
    clean = F.regexp_replace(inner, r"^(\./)+", "")
    return F.when(admissible_path(clean), clean)
