"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "le la les de des du et un une est que qui dans pour pas sur au aux par il elle ce "
    "der die das und zu den von mit dem ist im nicht ein eine auf für sich des als auch es an "
    "el los las y del se por con una su para al lo como más o pero sus le"
).split()
#: The symbols of the contract.
SYMBOLS = "#*$%&|<>"
#: The six white-space characters of the contract.
WHITE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A text is rejected when `metric` is below `least` or above `most`, in texts of at least `from_words` words."""

    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The rules that are always on: those of `base_failed`.
BASE_RULES = (
    Rule("n_words", least=50),
    Rule("repeat_word_ratio", most=0.5),
)
#: The default table. Ratios are by words (symbols, stop words) or by lines that have a word.
RULES = (
    Rule("mean_word_length", least=1.5, most=15),
    Rule("symbol_ratio", most=0.1),
    Rule("dup_line_ratio", most=0.9),
    Rule("stop_word_ratio", least=0.005, from_words=200),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once per row: lambdas would evaluate it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered_by_repeats(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more among `words`."""

    def by_sort(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return _let(marked, lambda s: _let(_starts(s), _union_length))

    def _starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

    def _union_length(starts: Column) -> Column:
        # Each window covers 3 words, or as many as lie before the next window's start.
        return F.aggregate(
            F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda total, x: total + x,
        )

    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<string>"))
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(by_sort(w)))


def text_metrics(text: Column) -> Column:
    """A struct of the counts that rules are about; null texts have no words. White space is `[\\x20\\x09-\\x0D]`."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
        return _let(
            lines,
            lambda kept: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
                _covered_by_repeats(words).cast("long").alias("n_repeat_words"),
                F.size(kept).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )

    return _let(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""), of_words)


def _value(m: Column, metric: str) -> Column:
    ratio = {
        "mean_word_length": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "n_words"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "repeat_word_ratio": ("n_repeat_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
    }.get(metric)
    return m[metric].cast("double") if ratio is None else F.try_divide(m[ratio[0]].cast("double"), m[ratio[1]])


def compile_rules(m: Column, rules: tuple[Rule, ...]) -> Column:
    """True where any rule rejects; a ratio without a denominator rejects nothing."""
    bad = F.lit(False)
    for rule in rules:
        value = _value(m, rule.metric)
        for limit, outside in ((rule.least, lambda v, x: v < x), (rule.most, lambda v, x: v > x)):
            if limit is not None:
                bad = bad | (F.coalesce(outside(value, F.lit(float(limit))), F.lit(False)) & (m["n_words"] >= rule.from_words))
    return bad


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts and verdict of every whole text, in one projection without shuffle or user function.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept, n_lines, n_stop_words. Null and empty texts have no words and fail the
    base rule of length. Texts with fewer than 3 words have no window. Repeated rows are
    judged one by one; other columns are neither read nor returned.
    """
    m = docs.select(docs[id_col].alias(id_col), text_metrics(docs[text_col]).alias("__m"))
    c = m["__m"]
    failed = compile_rules(c, base)
    return m.select(
        id_col,
        *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & ~compile_rules(c, rules)).alias("kept"),
        c["n_lines"].alias("n_lines"),
        c["n_stop_words"].alias("n_stop_words"),
    )


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rules nor the table reject."""
    m = docs.withColumn("__quality_metrics", text_metrics(docs[text_col]))
    c = m["__quality_metrics"]
    return m.filter(~compile_rules(c, base) & ~compile_rules(c, rules)).drop("__quality_metrics")
