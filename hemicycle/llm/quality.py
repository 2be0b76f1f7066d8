"""Quality rules of whole texts as one projection of built-in functions.

Counts come from the text; a table of thresholds on ratios of the counts is
compiled into the verdict. Rules that do not apply (a zero denominator) pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: frequent function words of the languages that the rules cover
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this or an at from not",
    "fr": "le la de et les des un une en du que est pour dans qui par sur pas au au plus",
    "de": "der die das und in zu den ist mit von für auf ein eine im nicht dem als des sich",
    "es": "el la de que y en los del se las por un con una no para su es al lo como o",
}
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= top / bottom <= high``; an open side is None.

    ``least`` is the number of words from which on the ratio says something.
    """

    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None
    least: int = 0

    def passes(self) -> Column:
        bottom = F.col(self.bottom) if self.bottom else F.lit(1)
        value = F.when(bottom > 0, F.col(self.top) / bottom)
        checks = []
        if self.low is not None:
            checks.append(value >= self.low)
        if self.high is not None:
            checks.append(value <= self.high)
        holds = F.coalesce(reduce(Column.__and__, checks, F.lit(True)), F.lit(True))
        return holds | (F.col("n_words") < self.least)


#: the production table: length, symbol, stop-word and line ratios
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 18.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 30),
    Rule("shouting", "n_upper", "word_chars", None, 0.35, 10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("one_word_lines", "n_lines", "n_words", None, 0.8, 10),
)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> tuple[dict[str, Column], ...]:
    """Words inside five-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash. Only texts in which a window does
    repeat are sorted.
    """
    h = F.col("_hashes")
    window = F.when(
        F.size(h) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashes = F.col("_windows")
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = F.when(again, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    s = F.col("_placed")
    same = lambda e, j: (F.get(s, j - 1)["h"].eqNullSafe(e["h"]) & (j > 0)) | F.get(s, j + 1)["h"].eqNullSafe(e["h"])
    starts = F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))
    covered = F.aggregate(
        F.transform(F.col("_starts"), lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_starts"), j + 1) - p, F.lit(5)))),
        F.lit(0), lambda a, x: a + x,
    )
    return {"_hashes": F.transform(words, lambda w: F.xxhash64(w))}, {"_windows": window}, {"_placed": placed}, {"_starts": starts}, {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules use; the columns of ``docs`` stay.

    The text is handled under a name of its own, so extra columns of ``docs``
    with the names of counts are replaced and all others kept. A null or empty
    text has zero in every count.
    """
    counts = [*BASE, "n_stop_words", "n_upper", "n_lines"]
    keep = [c for c in docs.columns if c not in counts]
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = {w for words in STOP_WORDS.values() for w in words.split()}
    stops = sorted(stops | {w.capitalize() for w in stops})
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text")).withColumns({"_words": words, "_lines": lines})
    for step in _repeat_words(F.col("_words")):
        df = df.withColumns(step)
    length = lambda c: F.char_length(c).cast("long")
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": length(F.translate("_text", SPACES, "")),
        "n_symbols": length("_text") - length(F.translate("_text", SYMBOLS, "")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
        "n_upper": length("_text") - length(F.regexp_replace("_text", "\\p{Lu}", "")),
    })
    return df.select(*[F.col(f"`{c}`") for c in keep], *counts)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``measure`` plus ``base_failed``, ``kept`` and the names of ``broken`` rules.

    The base rule fails texts under ten words or with over a fifth of their
    words in repeated windows; null and empty texts fail it.
    """
    return judge_counts(measure(docs, text_col), rules)


def judge_counts(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Verdicts on the counts of ``measure``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    return measured.withColumns({"base_failed": base, "broken": broken}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns.

    The verdict is used beside a row number, which the optimiser must not
    compute twice; without it the filter would be moved below the counts and
    every rule would count the text anew.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # no clash with the counts
    text = names[docs.columns.index(text_col)]
    judged = measure(docs.toDF(*names), text).withColumn("_row", F.monotonically_increasing_id())
    good = judge_counts(judged, rules).filter(F.col("kept") & (F.col("_row") >= 0))
    return good.select(*names).toDF(*docs.columns)
