"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; a line that stands in too many distinct documents of its host is
boilerplate and is removed; a document that this leaves depleted is rejected, as is one that fails
the base rules on length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"  # fixed values of the base rules
KEY = ["doc_id", "host", "text_hash"]


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """How many words lie in an n-word window found twice or more, its first place included."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def text_figures(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words by line)."""
    seen: set[str] = set()
    dup, hashes, counts = 0, [], []
    for line in text.split("\n"):
        words = line.encode().lower().split()
        if words:
            dup += line in seen
            seen.add(line)
        hashes.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else None)
        counts.append(len(words))
    chars = len(text) - sum(map(text.count, _SPACE))
    return sum(counts), chars, sum(map(text.count, _SYMBOLS)), dup, repeat_words(text.encode().split()), hashes, counts


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>"


def judge_lines(df: DataFrame, host: str = "source", max_share: float = 0.02, min_docs: int = 20, min_words: int = 10, max_repeat_percent: int = 20, min_left_percent: int = 30) -> DataFrame:
    """(doc_id, host, text_hash, figures, left_words, removed_lines, base_failed, kept) for each row.

    A line (lower-cased in ASCII, white space collapsed; lines without words don't count) is removed
    on a host where it stands in over ``min_docs`` and over ``max_share`` of the distinct documents;
    exact copies are one document. ``removed_lines``: 0-based places, null if none. A row is depleted
    if under ``min_words`` words or under ``min_left_percent`` percent of its words are left.

    A null text counts as empty and fails on length; a null host is a host; repeated rows each get
    the same verdict; an empty table gives none; other columns are ignored.
    """
    as_text = lambda c: F.col(c).cast("string")  # noqa: E731  so that pandas keeps nulls and large numbers
    slim = df.select(as_text("doc_id").alias("doc_id"), as_text(host).alias("host"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))

    def figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in _FIGURES.split(", ")]
        for pdf in frames:
            rows = pd.DataFrame([text_figures(t) for t in pdf.text], columns=names)
            yield pd.concat([pdf[KEY].reset_index(drop=True), rows], axis=1)

    figs = durable(slim.mapInPandas(figures, f"doc_id string, host string, text_hash long, {_FIGURES}"))
    figs = figs.withColumn("_row", F.monotonically_increasing_id())  # fixed, as the rows are written

    distinct = figs.groupBy("host", "text_hash").agg(F.first("line_hashes").alias("lines"))
    limits = distinct.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * max_share).alias("limit"))
    counts = distinct.select("host", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    limits = limits.withColumnRenamed("host", "_host")
    frequent = counts.where(F.col("n") > min_docs).join(limits, counts["host"].eqNullSafe(limits["_host"])).where("n > limit").select("_host", F.col("line").alias("_line"))

    lines = figs.select("_row", "host", F.posexplode("line_hashes").alias("at", "line"), "line_words").where("line is not null")
    lines = lines.select("_row", "host", "at", "line", F.element_at("line_words", F.col("at") + 1).alias("words"))
    hits = lines.join(frequent, lines["host"].eqNullSafe(frequent["_host"]) & (lines["line"] == frequent["_line"]))
    removed = hits.groupBy("_row").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("at")).alias("removed_lines"))

    out = figs.join(removed, "_row", "left").withColumn("left_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("left_words") < min_words) | (100 * F.col("left_words") < min_left_percent * F.col("n_words"))
    key = [F.col("doc_id").cast(df.schema["doc_id"].dataType), F.col("host").cast(df.schema[host].dataType), "text_hash"]
    return out.select(*key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words", "removed_lines", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def keep_good(df: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``df``, all columns, with boilerplate lines taken out of the text and
    ``n_chars``, if there, brought up to date. Rows without such lines stay as they are."""
    digest, doc, at, same, gone = (fresh(df, n) for n in ("_digest", "_doc", "_host", "_same", "_gone"))
    verdicts = judge_lines(df, host, **limits).where("kept").dropDuplicates(KEY)
    marked = verdicts.select(F.col("doc_id").alias(doc), F.col("host").alias(at), F.col("text_hash").alias(same), F.col("removed_lines").alias(gone))
    rows = df.withColumn(digest, F.xxhash64("text"))
    out = rows.join(marked, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col(host).eqNullSafe(F.col(at)) & (F.col(digest) == F.col(same)))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    whole = F.col(gone).isNull()
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(left))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(df.schema["n_chars"].dataType)))
    return out.select(*df.columns)
