"""How often every distinct term occurs, and in how many records.

Last-seen counters: tokens are hash-partitioned by term and come ordered by record; a term stores its
occurrences, its records and the last record it was seen in, and a record is counted when it differs
from the last one, so no set of records is ever held and no distinct pass goes before.

Each map task first adds up the tokens of its own rows that agree in term and record (Arrow
groups, flushed every `HELD` rows), so repeats of a hot term in a hot record don't travel; what comes from
several tasks is told apart by the counter. Terms are partitioned with a salt taken from the record: a term
that holds a third of all tokens spreads over as many groups as there are partitions, and since one record
of a term falls into one salt, the partial counters add up exactly. One full exchange; the second
carries a row per term and salt.

Defined results: null and empty terms (after trimming) are no terms; tokens without a record count
as occurrences but in no record; an empty input has no terms; a term of no record has 0 records.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestrata.functions.text import key
from lodestrata.operators.joins import partitions_of

HELD = 1 << 18  # rows that a task adds up before it passes them on


def tokens_of_fields(rows: DataFrame, fields: Sequence[str], record: str) -> DataFrame:
    """(field, term, record) of the trimmed lower-case values of each field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), key(f).alias("term")) for f in fields])
    return rows.select(F.col(record).alias("record"), F.inline(pairs)).where("term is not null")


def tokens_of_text(rows: DataFrame, text: str, record: str) -> DataFrame:
    """(field, term, record) of the words of a text, in lower case; the field is the column's name."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return rows.select(F.lit(text).alias("field"), F.explode(words).alias("term"), F.col(record).alias("record"))


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of one task that agree in everything, with their number."""
    held: list[pa.Table] = []

    def flush(tables: list[pa.Table]) -> pa.Table:
        names = [c for c in tables[0].column_names if c != "n"]
        out = pa.concat_tables(tables).combine_chunks().group_by(names, use_threads=False).aggregate([("n", "sum")])
        return out.select([*names, "n_sum"]).rename_columns([*names, "n"])

    for batch in batches:
        one = pa.Table.from_batches([batch])
        held.append(one.append_column("n", pa.array([1] * len(batch), pa.int64())))
        if sum(map(len, held)) >= HELD:
            held = [flush(held)]
            if len(held[0]) >= HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from flush(held).to_batches()


def term_counts(tokens: DataFrame, salts: int | None = None) -> DataFrame:
    """(field, term, occurrences, records) of (field, term, record) tokens, in any number and order."""
    salts = salts or partitions_of(tokens)
    schema = f"field string, term string, record {tokens.schema['record'].dataType.simpleString()}, n long"
    added = tokens.select("field", "term", "record").mapInArrow(_added_up, schema)
    salted = added.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int"))
    last_seen = F.lag("record").over(W.partitionBy("field", "term", "salt").orderBy("record"))
    is_new = F.col("record").isNotNull() & ~F.col("record").eqNullSafe(last_seen)
    counted = salted.select("field", "term", "n", is_new.alias("is_new"))
    return counted.groupBy("field", "term").agg(
        F.sum("n").alias("occurrences"), F.coalesce(F.sum(F.col("is_new").cast("long")), F.lit(0)).alias("records")
    )


def marked(counts: DataFrame, all_records: DataFrame, fewest: int = 3, share: float = 0.5) -> DataFrame:
    """Adds `mark`: rare in fewer than `fewest` records, common in more than `share` of all; else null.

    `all_records` is one row with one number, brought in as a scalar subquery.
    """
    rare = F.col("records") < fewest
    common = F.col("records") > F.lit(share) * all_records.scalar()
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common"))
