"""Cutting texts into chunks with Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import lines, non_blank_lines, normalised_path

MIN_CHARS, MIN_LINES, MAX_CHARS, TARGET_CHARS, OVERLAP = 50, 2, 2000, 1500, 0.15
WINDOW, WINDOW_OVERLAP = 50, 5


def window_count(n: Column, width: Column, overlap: Column) -> Column:
    """Number of windows of ``width`` lines with ``overlap`` over ``n`` lines, in closed form."""
    return F.when(n <= width, F.lit(1)).otherwise(F.ceil((n - overlap) / (width - overlap))).cast("int")


def too_small(c: Column) -> Column:
    return (F.length(c) < MIN_CHARS) | (non_blank_lines(c) < MIN_LINES)


def too_large(c: Column) -> Column:
    return F.length(c) > MAX_CHARS


def _windows(df: DataFrame, text: str, width: Column, overlap: Column) -> DataFrame:
    """One row per window: k, first (0-based), n_lines, part_text."""
    return (
        df.withColumn("_l", lines(F.col(text)))
        .withColumn("_w", width)
        .withColumn("_o", overlap)
        .withColumn("_k", window_count(F.size("_l"), F.col("_w"), F.col("_o")))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("first", (F.col("k") * (F.col("_w") - F.col("_o"))).cast("int"))
        .withColumn("_s", F.slice("_l", F.col("first") + 1, F.col("_w").cast("int")))
        .withColumn("n_lines", F.size("_s"))
        .withColumn("part_text", F.array_join("_s", "\n"))
        .drop("_l", "_w", "_o", "_k", "_s")
    )


def line_windows(files: DataFrame, path: str = "file_path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping line windows of every file, with the columns ``keep``; blank windows are skipped and do not count in the id."""
    from pyspark.sql import Window

    w = _windows(files.select(path, content, *keep).filter(F.col(content).isNotNull()), content, F.lit(WINDOW), F.lit(WINDOW_OVERLAP))
    kept = w.filter(F.regexp_replace("part_text", r"\s+", "") != "")
    n = F.row_number().over(Window.partitionBy(path).orderBy("k")) - 1
    return kept.withColumn("n", n).select(
        F.concat(normalised_path(F.col(path)), F.lit("_L"), (F.col("first") + 1).cast("string"), F.lit("_fallback"), F.col("n").cast("string")).alias("id"),
        F.col(path).alias("file_path"),
        F.col("part_text").alias("content"),
        (F.col("first") + 1).alias("start_line"),
        (F.col("first") + F.col("n_lines")).alias("end_line"),
        *keep,
    )


def split_large(chunks: DataFrame) -> DataFrame:
    """Chunks over the size limit as overlapping parts of about ``TARGET_CHARS``; signature and docstring stay on part 0.

    Part names carry their number in ``part_no``; ``name`` stays the symbol's name.
    """
    n = F.size(lines(F.col("content")))
    per = F.greatest(F.lit(1), F.ceil(F.lit(TARGET_CHARS) / (F.length("content") / n))).cast("int")
    over = F.floor(F.lit(OVERLAP) * per).cast("int")
    big = _windows(chunks.filter(too_large(F.col("content"))), "content", per, over)
    whole = [c for c in chunks.columns if c not in ("content", "start_line", "end_line", "id", "signature", "docstring")]
    on_first = [F.when(F.col("k") == 0, F.col(c)).alias(c) for c in ("signature", "docstring") if c in chunks.columns]
    parts = big.select(
        F.concat("id", F.lit("_p"), F.col("k").cast("string")).alias("id"),
        F.col("part_text").alias("content"),
        (F.col("start_line") + F.col("first")).alias("start_line"),
        (F.col("start_line") + F.col("first") + F.col("n_lines") - 1).alias("end_line"),
        F.col("k").alias("part_no"),
        *on_first,
        *whole,
    )
    small = chunks.filter(~too_large(F.col("content"))).withColumn("part_no", F.lit(None).cast("int"))
    return parts.unionByName(small)


def signature(content: Column) -> Column:
    """First line, trimmed; up to four more non-blank lines are joined until it has ``{`` or ``:``; cut before ``{``.

    Null if the first line is blank.
    """
    ls = F.transform(F.slice(lines(content), 1, 5), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    joined = F.aggregate(
        F.slice(ls, 2, 4),
        ls[0],
        lambda s, x: F.when(s.contains("{") | s.contains(":") | (x == ""), s).otherwise(F.concat(s, F.lit(" "), x)),
    )
    cut = F.when(F.instr(joined, "{") > 1, F.rtrim(F.substring_index(joined, "{", 1))).otherwise(joined)
    return F.when(ls[0] != "", cut)
