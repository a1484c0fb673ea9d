"""Quality rules: a table of thresholds over ratios of a text, compiled into one projection of built-in functions.

A row of the table names a ratio of two measures and its bounds in hundredths, so a rule is a comparison of whole numbers
and every engine decides it alike. No row leaves the JVM, nothing is shuffled, and each text is measured whole.

Defined results: a null text counts as empty (no words, so the base rules fail it); a null id stays null; repeated rows
are judged one by one; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = tuple((
    "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their "
    "there they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer es für ich im ist mit nach "
    "nicht oder sich sie sind um und unter von vor war wie wird zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et il la le les leur mais ne nous ont ou par pas pour qui que sa "
    "se ses son sont sur un une vous "
    "al como con del el ella en era es esta este fue ha hay las lo los más no o para pero por se sin su sus también una y "
    "ya").split())


@dataclass(frozen=True)
class Rule:
    """``top / bottom`` has to lie between ``least`` and ``most`` hundredths; without ``bottom`` it is ``top`` itself."""

    name: str
    top: str
    bottom: str | None = None
    least: int | None = None
    most: int | None = None


#: What the base verdict holds against a text.
BASE = (
    Rule("few words", "n_words", least=5000),
    Rule("repeated words", "n_repeat_words", "n_words", most=50),
)
#: What is asked of the others.
RULES = (
    Rule("word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("shouts", "n_shouts", "n_words", most=20),
    Rule("stop words", "n_stop_words", "n_words", least=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("cut lines", "n_cut_lines", "n_lines", most=30),
    Rule("listed lines", "n_listed_lines", "n_lines", most=90),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def _covered(places: Column, width: int) -> Column:
    """How many places lie in windows of ``width`` that start at the ascending ``places``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = F.aggregate(places, start, lambda done, at: F.struct(
        (done["n"] + at + width - F.greatest(at, done["end"])).alias("n"), (at + width).alias("end")))
    return step["n"]


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that the text holds twice or more.

    Windows are sorted with their places, so equal ones are neighbours; a text without an equal pair is not sorted.
    """
    def places(ordered: Column) -> Column:
        def again(item: Column, at: Column) -> Column:
            alike = [item["w"].eqNullSafe(F.get(ordered, at + step)["w"]) for step in (-1, 1)]
            return F.when(alike[0] | alike[1], item["at"])
        return F.sort_array(F.array_compact(F.transform(ordered, again)))

    def count(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda w, at: F.struct(w.alias("w"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered(bound(rows, places), width))

    starts = F.sequence(F.lit(0), F.size(words) - width)
    windows = F.transform(starts, lambda at: F.concat_ws(" ", *[F.get(words, at + step) for step in range(width)]))
    return F.when(F.size(words) < width, 0).otherwise(bound(windows, count))


def measures(text: Column) -> Column:
    """All measures of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def only(letters: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))

    def of(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words), "word_chars": F.length(F.regexp_replace(text, SPACES, "")),
            "n_symbols": only(SYMBOLS), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words), "n_shouts": only("!"),
            "n_stop_words": _count(words, lambda w: F.lower(w).isin(*STOP_WORDS)), "n_lines": F.size(lines),
            "n_cut_lines": _count(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z")),
            "n_listed_lines": _count(lines, lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))}
        return F.struct(*[column.cast("long").alias(name) for name, column in found.items()])

    return bound(words, lambda w: bound(lines, lambda found: of(w, found)))


def broken(rules: tuple[Rule, ...], found: Column) -> Column:
    """Names of the rules that the measures break, in order of the table."""
    def breaks(rule: Rule) -> Column:
        value, scale = 100 * found[rule.top], found[rule.bottom] if rule.bottom else F.lit(1)
        sides = [value < scale * rule.least] if rule.least is not None else []
        sides += [value > scale * rule.most] if rule.most is not None else []
        return F.when(reduce(Column.__or__, sides), F.lit(rule.name))

    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[breaks(rule) for rule in rules]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``kept`` and the names of the broken rules of every document."""
    def verdict(found: Column) -> Column:
        return F.struct(found.alias("m"), broken(base, found).alias("base"), broken(rules, found).alias("own"))

    rows = docs.select("doc_id", bound(measures(F.col("text")), verdict).alias("v"))
    failed = F.size("v.base") > 0
    return rows.select(
        "doc_id", "v.m.n_words", "v.m.word_chars", "v.m.n_symbols", "v.m.n_dup_lines", "v.m.n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size("v.own") == 0)).alias("kept"),
        "v.m.n_shouts", "v.m.n_stop_words", "v.m.n_lines", "v.m.n_cut_lines", "v.m.n_listed_lines",
        F.array_join(F.concat("v.base", "v.own"), ", ").alias("broken_rules"))
