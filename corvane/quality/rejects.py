"""Loading delimited lines: sound ones as typed columns, the others apart with the reason.

Lines are indexed structurally, a whole Arrow batch at once: one numpy mask of the quote signs, its prefix parity within
the line, and from that the delimiters and field ends. No line is walked sign by sign in Python.

Null lines count as empty. An empty table gives no rows. Lines of any length are handled; one line is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.functions.text import is_blank, trimmed, usable_level, usable_source, valid_drug_id

QUOTE, COMMA = ord('"'), ord(",")


def index_lines(lines: pa.Array, columns: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The fields (unquoted) of each line, whether its quoting is broken, and how many columns it has.

    Fields of lines that are broken or of another width are null.
    """
    lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
    lines = pa.array(lines.fill_null(""), pa.large_string()) if lines.type != pa.large_string() else lines.fill_null("")
    count = len(lines)
    ends = np.frombuffer(lines.buffers()[1], np.int64, count + 1, lines.offset * 8) if count else np.zeros(1, np.int64)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1]] if count and lines.buffers()[2] else np.zeros(0, np.uint8)
    start, stop = ends[:-1] - ends[0], ends[1:] - ends[0]
    # one carriage return at the end is no part of the line
    last = np.where(stop > start, data[np.maximum(stop - 1, 0)] if len(data) else 0, 0)
    stop = stop - (last == 13)

    inside = np.flatnonzero(data == QUOTE)
    line_of_quote = np.searchsorted(start, inside, "right") - 1
    keep = inside < stop[line_of_quote] if len(inside) else np.zeros(0, bool)
    inside, line_of_quote = inside[keep], line_of_quote[keep]
    quotes = np.bincount(line_of_quote, minlength=count)
    before_line = np.concatenate([[0], np.cumsum(quotes)])[:-1]
    broken = quotes % 2 == 1

    commas = np.flatnonzero(data == COMMA)
    line_of_comma = np.searchsorted(start, commas, "right") - 1
    parity = (np.searchsorted(inside, commas) - before_line[line_of_comma]) % 2 if len(commas) else np.zeros(0, int)
    commas, line_of_comma = commas[parity == 0], line_of_comma[parity == 0]
    width = np.bincount(line_of_comma, minlength=count) + 1

    # fields: from the line's start or behind a delimiter to the next delimiter or the line's end
    first = np.concatenate([[0], np.cumsum(width)])
    begin, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    begin[first[:-1]], end[first[1:] - 1] = start, stop
    at = first[:-1][line_of_comma] + np.arange(len(commas)) - np.concatenate([[0], np.cumsum(width - 1)])[:-1][line_of_comma]
    begin[at + 1], end[at] = commas + 1, commas
    line_of_field = np.repeat(np.arange(count), width)

    lo, hi = np.searchsorted(inside, begin), np.searchsorted(inside, end)
    own = hi - lo
    some = own > 0
    quoted = some & (own >= 2)
    if len(inside):
        quoted &= (inside[np.minimum(lo, len(inside) - 1)] == begin) & (inside[np.maximum(hi - 1, 0)] == end - 1) & (own % 2 == 0)
        # between the first and the last, quotes stand in adjacent twos
        owner = np.repeat(np.arange(len(own)), own)
        rank = np.arange(len(inside)) - lo[owner]
        opens = (rank % 2 == 1) & (rank < own[owner] - 1)
        lone = np.zeros(len(inside), bool)
        lone[:-1] = opens[:-1] & (inside[1:] != inside[:-1] + 1)
        bad = np.zeros(len(own), bool)
        bad[owner[lone]] = True
        quoted &= ~bad
    np.logical_or.at(broken, line_of_field[some & ~quoted], True)

    sound = ~broken & (width == columns)
    fields = []
    for k in range(columns):
        f = first[:-1][sound] + k
        b, e, q = begin[f], end[f], quoted[f]
        b, e = b + q, e - q
        sizes = e - b
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(b, sizes)
        values = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes() if len(data) else b""))
        values = pc.if_else(pa.array(q), pc.replace_substring(values, '""', '"'), values)
        where = np.full(count, -1)
        where[sound] = np.arange(len(b))
        fields.append(values.take(pa.array(where, mask=where < 0)).cast(pa.string()))
    return fields, broken, width


def parse_lines(df: DataFrame, line: str, names: list[str]) -> DataFrame:
    """df with the fields of its column `line` under `names`, and fault: quoting, column_count or null."""
    kept = [f for f in df.schema.fields]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in names], T.StructField("fault", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, broken, width = index_lines(batch.column(batch.schema.get_field_index(line)), len(names))
            fault = np.where(broken, "quoting", np.where(width != len(names), "column_count", "")).astype(object)
            yield pa.RecordBatch.from_arrays([*batch.columns, *fields, pa.array([x or None for x in fault], pa.string())], names=[*batch.schema.names, *names, "fault"])

    return df.mapInArrow(run, schema)


def pair_fault(a: Column, b: Column, drugs: list[Column], level: Column, source: Column) -> Column:
    """The first that applies of missing_value, invalid_id, invalid_level, invalid_source_file; null if sound."""
    blank = is_blank(level) | is_blank(a) | is_blank(b)
    for d in drugs:
        blank = blank | is_blank(d)
    return (
        F.when(blank, "missing_value")
        .when(~valid_drug_id(a) | ~valid_drug_id(b), "invalid_id")
        .when(~usable_level(level, unknown=True), "invalid_level")
        .when(~usable_source(source), "invalid_source_file")
    )


FIELDS = ["DDInterID_A", "Drug_A", "DDInterID_B", "Drug_B", "Level"]


def load_lines(lines: DataFrame) -> DataFrame:
    """Every line with its fields and, in reason, why it is rejected; null for sound ones, whose fields are typed."""
    got = parse_lines(lines.select("line_id", "source_file", "raw_line", "loaded_at"), "raw_line", FIELDS)
    why = pair_fault(F.col("DDInterID_A"), F.col("DDInterID_B"), [F.col("Drug_A"), F.col("Drug_B")], F.col("Level"), F.col("source_file"))
    return got.withColumn("reason", F.coalesce("fault", why)).drop("fault")


def check_rows(rows: DataFrame) -> DataFrame:
    """The rows of the pair loader's quarantine with, in reason, why they fail, if they do."""
    return rows.withColumn("reason", pair_fault(F.col("DDInterID_A"), F.col("DDInterID_B"), [F.col("Drug_A"), F.col("Drug_B")], F.col("Level"), F.col("source_file")))


def typed(sound: DataFrame) -> DataFrame:
    """Ids as numbers, level and category in their own spelling."""
    number = lambda c: F.regexp_replace(F.col(c), "[^0-9]", "").cast("decimal(38,0)").cast("string")
    return sound.select(
        "line_id",
        number("DDInterID_A").alias("drug_a_number"),
        trimmed("Drug_A").alias("drug_a_name"),
        number("DDInterID_B").alias("drug_b_number"),
        trimmed("Drug_B").alias("drug_b_name"),
        F.initcap(trimmed("Level")).alias("level"),
        F.upper(F.regexp_extract(F.lower("source_file"), r"code_([a-z])\.csv", 1)).alias("atc_category"),
        "loaded_at",
    )


def rejects(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(origin, record_id, reason) of all that fail, of both inputs."""
    a = load_lines(lines).filter("reason is not null").select(F.lit("line").alias("origin"), F.col("line_id").alias("record_id"), "reason")
    b = check_rows(rows).filter("reason is not null").select(F.lit("row").alias("origin"), F.col("row_id").alias("record_id"), "reason")
    return a.unionByName(b)
