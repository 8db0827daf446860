"""Text statistics as DataFrame expressions, and the threshold grid that the
two quality learners cut them on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Ratios of the statistics, and the cuts at which rules and bins may split them.
GRID = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6],
    "upper_share": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "marks_per_word": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6],
    "dup_line_share": [0.01, 0.05, 0.1, 0.2, 0.4, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "chars_per_word": [1.5, 2.5, 3.5, 6.0, 8.0, 11.0, 15.0],
    "words": [3.0, 10.0, 30.0, 100.0, 1000.0, 10000.0],
}


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, though used many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort the
    (hash, position) pairs, keep those equal to a neighbour, and add up the
    steps between their positions, at most a window each."""
    def of_sorted(s: Column) -> Column:
        again = F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull())
        return _once(F.array_sort(again), lambda p: F.aggregate(
            F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, b: a + b))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _once(F.array_sort(pairs), of_sorted)


def _of_words(w: Column) -> Column:
    n = F.size(w)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                            lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))
    repeat = _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)))
    return F.struct(n.cast("long").alias("n_words"), F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"))


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def doc_stats(text: Column) -> Column:
    """Struct of counts of a whole text (null: an empty text), all long:
    n_words, n_repeat_words, word_chars, n_symbols, n_lines and n_dup_lines
    (lines with a word), n_upper, n_marks (exclamation marks)."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\x0c", "")) > 0)
    return F.struct(
        _once(words(text), _of_words).alias("w"), _once(lines, _of_lines).alias("l"),
        F.length(F.translate(t, " \t\n\r\x0b\x0c", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"), without("!").cast("long").alias("n_marks"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"))


def flat(stats: Column) -> list[Column]:
    """The counts of a ``doc_stats`` struct as columns."""
    return [stats["w"][c].alias(c) for c in ("n_words", "n_repeat_words")] + [
        stats["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")] + [
        stats[c].alias(c) for c in ("word_chars", "n_symbols", "n_marks", "n_upper")]


def ratios() -> dict[str, Column]:
    """The ``GRID`` features of flattened counts; 0 where the base is 0."""
    c = F.col
    per = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), c(b)), F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "upper_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "chars_per_word": per("word_chars", "n_words"),
        "words": c("n_words").cast("double"),
    }


def bins() -> dict[str, Column]:
    """Per feature the number of its cuts that it reaches: 0 .. len(cuts)."""
    return {f: sum((F.when(v >= F.lit(t), 1).otherwise(0) for t in GRID[f]), F.lit(0)) for f, v in ratios().items()}
