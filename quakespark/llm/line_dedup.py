"""Line dedup by content-defined chunks of lines.

A rolling hash runs over the hashes of a text's lines, two at a time. A chunk
ends after a line where a bit of the rolling hash falls from 1 to 0, about
every fourth line; so boundaries depend on three neighbouring lines and not on
where in the text they stand, and no chunk but a text's first and last has a
single line. Chunks of several lines that occur again anywhere are removed
but for their first occurrence. Candidates are found by digest with the
tree-merge of exact dedup, and removed only after their bytes were compared
with the first occurrence's.

Such chunks miss most passages of fewer lines than a chunk has, as those share
theirs with foreign lines. drop_repeated_passages has no chunk boundaries: it
looks at every pair of neighbouring lines and at every line of LONG words, so
it finds each repeated passage of two lines or more, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import discard, join_small, settle, word_count
from quakespark.llm.exact_dedup import elect

RUNS, FAN = 64, 8
#: A line of so many words is a passage by itself.
LONG = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, also within lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order, each an array of its lines. Null text is one empty line."""

    def cut(lines: Column) -> Column:
        def with_bits(bits: Column) -> Column:
            ends = F.when(F.size(lines) > 2, F.filter(F.sequence(F.lit(2), F.size(lines) - 1), lambda i: (F.element_at(bits, i) == 0) & (F.element_at(bits, i - 1) == 1))).otherwise(F.array().cast("array<int>"))
            bounds = F.concat(F.array(F.lit(0)), ends, F.array(F.size(lines)))
            return let(bounds, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda j: F.slice(lines, F.element_at(b, j) + 1, F.element_at(b, j + 1) - F.element_at(b, j))))

        def rolled(h: Column) -> Column:
            before = lambda i: F.when(i > 0, F.element_at(h, i)).otherwise(0)
            return F.transform(h, lambda x, i: F.pmod(F.floor((x + before(i) * 31) / 1024), F.lit(2)))

        return let(let(F.transform(lines, line_hash), rolled), with_bits)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def _row(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


def _exploded(docs: DataFrame) -> DataFrame:
    """One row for each chunk of several lines: id, row, chunk, sha, bytes, run, text."""
    split = docs.select("id", _row(F.col("id"), F.col("text")).alias("row"), F.posexplode(chunks_of(F.col("text"))).alias("chunk", "lines")).where(F.size("lines") > 1)
    named = split.select("id", "row", "chunk", F.array_join("lines", "\n").alias("text"))
    return named.select("id", "row", "chunk", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes"), F.pmod(F.xxhash64("row", "chunk"), F.lit(RUNS)).cast("int").alias("run"), "text")


def passages_of(text: Column) -> Column:
    """The passages of a text, (chunk, text): 2i is line i if it has LONG words, 2i + 1 the lines i and i + 1."""

    def cut(lines: Column) -> Column:
        entry = lambda number, text: F.struct(number.cast("int").alias("chunk"), text.alias("text"))
        long = F.filter(F.transform(lines, lambda x, i: entry(i * 2, x)), lambda e: word_count(e["text"]) >= LONG)
        pair = lambda i: entry(i * 2 - 1, F.concat(F.element_at(lines, i), F.lit("\n"), F.element_at(lines, i + 1)))
        return F.when(F.size(lines) > 1, F.concat(long, F.transform(F.sequence(F.lit(1), F.size(lines) - 1), pair))).otherwise(long)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("chunk").alias("chunk"))


def _verified(found: DataFrame, by: list[str]) -> DataFrame:
    """(id, row, removed): the chunks whose bytes are those of their digest's first occurrence."""
    firsts = found.where("own").groupBy("sha", "bytes").agg(F.min("text").alias("kept_text"))
    spread = found.select(*by).distinct().join(firsts, ["sha", "bytes"])
    same = found.where("not own").join(spread, by).where(F.col("text") == F.col("kept_text"))
    return same.groupBy("id", "row").agg(F.sort_array(F.collect_set("chunk")).alias("removed"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, row, removed) for rows of (id, text) that lose chunks; removed: the chunks' numbers from 0."""
    chunks = _exploded(docs)
    keys = settle(chunks.drop("text"), "chunks")
    won = elect(keys, ["sha", "bytes"], _place(), RUNS, FAN)
    by = ["sha", "bytes", "run"]
    return _verified(settle(chunks.join(won, by).withColumn("own", _place() == F.col("first")), "candidates"), by)


def _repeating(keys: DataFrame) -> DataFrame:
    """The rows of settled (sha, bytes, ...) whose digest has several rows, and few others. ``keys`` is deleted.

    Only 64-bit marks of digests are shuffled to count them, so what never
    repeats does not go through the merge's levels. Two digests with the same
    mark stay both: nothing that repeats is lost.
    """
    mark = F.xxhash64("sha", "bytes")
    marks = settle(keys.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).where("n > 1").select("mark"), "marks")
    found = settle(join_small(keys.withColumn("mark", mark), marks, ["mark"], "left_semi").drop("mark"), "repeating")
    discard(keys, marks)
    return found


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(id, row, removed) for rows of (id, text) that lose passages; removed: the numbers of passages_of.

    Digests are shuffled without text, and are MD5: bytes decide. Only texts
    that hold repeated digests are cut again, to those passages.
    """
    cut = docs.select("id", _row(F.col("id"), F.col("text")).alias("row"), F.explode(passages_of(F.col("text"))).alias("p"))
    keys = cut.select("id", "row", "p.chunk", F.unhex(F.md5(F.col("p.text").cast("binary"))).alias("sha"), F.octet_length("p.text").alias("bytes"))
    keys = _repeating(settle(keys.withColumn("run", F.pmod(F.xxhash64("row", "chunk"), F.lit(RUNS)).cast("int")), "passages"))
    won = elect(keys, ["sha", "bytes"], _place(), RUNS, FAN)
    by = ["sha", "bytes", "run"]
    several = keys.join(won, by).select("id", "row", F.struct("chunk", *by, (_place() == F.col("first")).alias("own")).alias("w"))
    wanted = several.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("w").alias("wanted"))
    rows = docs.withColumn("row", _row(F.col("id"), F.col("text"))).join(wanted, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")))
    text = lambda all_, c: F.array_join(F.slice(all_, F.shiftright(c, 1) + 1, c % 2 + 1), "\n")
    filled = let(F.split("text", "\n", -1), lambda all_: F.transform("wanted", lambda w: F.struct(w.alias("w"), text(all_, w["chunk"]).alias("text"))))
    found = rows.select("id", "row", F.explode(filled).alias("f")).select("id", "row", "f.w.*", "f.text")
    return _verified(settle(found, "candidates"), by)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: identifier, n_lines, n_removed, removed_chunks, text.

    Lines end at line feeds. Of a chunk's occurrences that in the row with the
    smallest identifier stays (null last), and there the first. Texts of one
    line lose nothing; a text may become empty. Null text counts as empty.
    Rows equal in identifier and text count as one and end up alike. Extra
    columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    gone = repeated_chunks(slim).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "removed")
    joined = slim.withColumn("row", _row(F.col("id"), F.col("text"))).join(gone, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    kept = let(chunks_of(F.col("text")), lambda all_: F.flatten(F.filter(all_, lambda c, i: ~F.array_contains(F.col("removed"), i))))
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    left = joined.withColumn("kept", F.when(F.col("removed").isNotNull(), kept))
    return left.select(
        F.col("id").alias(id_col),
        lines.alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(lines - F.size("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("removed_chunks"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: identifier, n_lines, n_removed, removed_passages, text.

    A line goes if it lies in a passage (two neighbouring lines, or one line of
    LONG words) that occurs earlier: in a row with a smaller identifier (null
    last) or further up. So of a longer passage all lines go, and every line
    stays where it first occurs. removed_passages counts the runs of lines that
    went. Rows are treated as in drop_repeated_lines.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    gone = repeated_passages(slim).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "removed")
    joined = slim.withColumn("row", _row(F.col("id"), F.col("text"))).join(gone, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    lost = F.flatten(F.transform("removed", lambda c: F.when(c % 2 == 1, F.array(F.shiftright(c, 1), F.shiftright(c, 1) + 1)).otherwise(F.array(F.shiftright(c, 1)))))
    left = joined.withColumn("lost", F.array_sort(F.array_distinct(lost)))
    kept = let(F.split("text", "\n", -1), lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("lost")), lambda i: F.get(all_, i)))
    left = left.withColumn("kept", F.when(F.col("lost").isNotNull(), kept))
    runs = F.size(F.filter(F.transform("lost", lambda x, i: (i == 0) | (x - F.get(F.col("lost"), i - 1) > 1)), lambda first: first))
    return left.select(
        F.col("id").alias(id_col),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_removed"),
        F.when(F.col("lost").isNull(), 0).otherwise(runs).cast("long").alias("removed_passages"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
