"""Line dedup by winnowing (Schleimer, Wilkerson and Aiken), in DataFrame functions alone.

Lines are compared without white space at their ends; blank lines don't count and stay. Of each window of MIN_LINES
consecutive lines the least hash, of equal ones the first, is selected with its place: an anchor. Two equal windows select the same line,
so anchors whose hash occurs once are put aside. The others' places are joined, for each window that selected them, with the
first place where an equal window was selected, and the match is extended from the anchor both ways, line by line. Where a match isn't the first
(smaller id, then earlier place) its lines are deleted, so of equal windows the one that starts first stays, and a repeated run goes from its first line to its last.
With long_words, fewer lines are a window too if they have so many words together, so a long line that repeats alone goes as well.

A match is extended to MIN_LINES - 1 lines each way; a longer run has an anchor in each of its windows, so its matches overlap.
Anchors and windows are counted in each task before they are shuffled, and those of a line or window that is
frequent are dealt to several tasks; a run that a third of all documents share costs a row for each place, never a pair. A document's text moves once, when its deletions join it.

Rows: a null text stays null and has no lines; a text of fewer lines stays as it is; a null id comes first; rows that repeat both id and text are
one document and all get its result; rows that repeat an id with other texts are in an order by the text's hash. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_spread

MIN_LINES = 3
_BLANKS = " \t\r\f\v"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _places(raw: Column) -> Column:
    """Places of lines that aren't blank, from 0."""
    return F.filter(F.transform(raw, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "[ \\t\\r\\f\\x0B]+"), lambda x: x != ""))


def _windows(n: int, long_words: int | None) -> list[tuple[int, int]]:
    """Of all windows that hold a line: how far it is from their start, and their length."""
    return [(o, size) for size in range(1 if long_words else n, n + 1) for o in range(size)]


def _reach(n: int, step: int) -> Column:
    """How many lines in a row, to the right or left of the middle one, don't take the minimum from it: of equal lines the first has it."""
    out = F.lit(n - 1)
    for k in reversed(range(1, n)):
        other = F.get("near", F.lit(n - 1 + step * k))
        out = F.when((other > F.col("f")) if step < 0 else (other >= F.col("f")), out).otherwise(k - 1)
    return out


def _chosen(n: int, long_words: int | None) -> Column:
    """The windows that have their minimum in the middle line, which reaches `back` lines to the left and `on` to the right."""
    words = lambda o, size: sum((F.get("words", F.lit(n - 1 + k)) for k in range(-o, size - o)), F.lit(0))
    fits = lambda o, size: (F.col("back") >= o) & (F.col("on") >= size - 1 - o) & ((words(o, size) >= long_words) if size < n else F.lit(True))
    return F.array_compact(F.array(*(F.when(fits(o, size), F.struct(F.lit(o).alias("o"), F.lit(size).alias("size"))) for o, size in _windows(n, long_words))))


def anchors(docs: DataFrame, n: int, long_words: int | None) -> DataFrame:
    """Of docs (k, h, lines: their hashes and words) each line p that is the minimum f of some window, the hashes near it, and those windows."""
    around = lambda lines, i, part: F.array(*(F.get(lines, i + k)[part] for k in range(1 - n, n)))
    words = lambda lines, i: around(lines, i, "words") if long_words else F.lit(None).cast("array<int>")
    each = let(F.col("lines"), lambda lines: F.transform(lines, lambda _, i: F.struct(i.alias("p"), around(lines, i, "hash").alias("near"), words(lines, i).alias("words"))))
    rows = docs.select("k", "h", F.inline(each)).withColumn("f", F.get("near", F.lit(n - 1)))
    return rows.withColumns({"back": _reach(n, -1), "on": _reach(n, 1)}).select("k", "h", "p", "f", "near", _chosen(n, long_words).alias("windows")).filter(F.size("windows") > 0)


def _alike(n: int, step: int) -> Column:
    """By how many lines the match of two anchors reaches on, to the right or left."""
    out = F.lit(n - 1)
    for k in reversed(range(1, n)):
        at = F.lit(n - 1 + step * k)
        out = F.when(F.get("near", at) == F.get("first.near", at), out).otherwise(k - 1)
    return out


def repeated_runs(docs: DataFrame, n: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Of docs (k, h, text; h tells apart texts of one k): k, h and runs, each the place among lines that count at which a run begins that has occurred before, and its lines."""
    hashed = F.transform(F.filter(F.transform(F.split("text", "\n", -1), _trimmed), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("hash"), (_words(x) if long_words else F.lit(0)).alias("words")))
    found = anchors(docs.filter("text IS NOT NULL").select("k", "h", hashed.alias("lines")), n, long_words)
    prints = found.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1")
    met = join_spread(found, prints, ["f"], ["k", "h", "p"]).select("k", "h", "p", "near", F.inline("windows"))
    met = met.withColumn("lines", F.slice("near", F.lit(n) - F.col("o"), F.col("size")))
    place = F.struct("k", "h", "p", "near")
    firsts = met.groupBy("lines").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = join_spread(met, firsts, ["lines"], ["k", "h", "p"]).filter(place > F.col("first"))
    run = F.struct((F.col("p") - F.col("back")).alias("start"), (F.col("back") + F.col("on") + 1).alias("lines"))
    runs = pairs.select("k", "h", "p", _alike(n, -1).alias("back"), _alike(n, 1).alias("on")).select("k", "h", run.alias("run"))
    return runs.groupBy("k", "h").agg(F.collect_set("run").alias("runs"))


def remove_repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with the text less its repeated runs, and as last columns n_lines (that count) and n_removed."""
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    runs = repeated_runs(rows.select("k", "h", "text"), min_lines, long_words).select(F.col("k").alias("k2"), F.col("h").alias("h2"), "runs")
    both = rows.join(runs, F.expr("k <=> k2 AND h = h2"), "left")

    def cut(raw: Column) -> Column:
        gone = lambda places: F.flatten(F.transform("runs", lambda s: F.slice(places, s["start"] + 1, s["lines"])))
        kept = lambda bad: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), bad), lambda i: F.get(raw, i)), "\n")
        return let(_places(raw), lambda places: let(F.array_distinct(gone(places)), lambda bad: F.struct(kept(bad).alias("text"), F.size(places).alias("n_lines"), F.size(bad).alias("n_removed"))))

    whole = lambda raw: F.struct(F.col("text").alias("text"), F.size(_places(raw)).alias("n_lines"), F.lit(0).alias("n_removed"))
    out = let(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda raw: F.when(F.col("runs").isNull(), whole(raw)).otherwise(cut(raw)))
    done = both.select("row", out.alias("out"))
    columns = [F.col("out.text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns, F.col("out.n_lines").cast("long").alias("n_lines"), F.col("out.n_removed").cast("long").alias("n_removed"))
