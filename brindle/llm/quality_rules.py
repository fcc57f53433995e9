"""Quality rules: a threshold table compiled into one projection of built-in functions. No user function, shuffle or collect.

Words are runs without ASCII white space, lines are parts between ``\\n``. Defined results: a null or empty text has no word
and no line, all its ratios are 0, and the base rule rejects it. A row is judged by itself, so ties and repeated rows give
repeated results and an empty table gives an empty one. Other columns of the input are passed through only when
named in `keep`, so names that clash with measures do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages, in lower case.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by this be from or an at have not "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par sur pas au plus "
    "el los del se las por con no una su para como más al lo pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [least, most]; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None

    def fails(self, value: Column) -> Column:
        sides = [value < self.least] * (self.least is not None) + [value > self.most] * (self.most is not None)
        return reduce(lambda a, b: a | b, sides, F.lit(False))


#: The production table. Base rules are the first two; the others look for symbols, repeated lines and missing prose.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_percent", most=50))
RULES = (
    Rule("symbols_per_word", most=0.3),
    Rule("mean_word_chars", least=2, most=20),
    Rule("dup_line_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.005),
    Rule("upper_ratio", most=0.3),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in runs of n words found twice or more, the first included.

    The runs are sorted with their places, so equal ones are neighbours: O(k log k) in the words of one text.
    """

    def marked(runs: Column) -> Column:
        # Equal runs stand side by side; [-1] and [size] are out of range and null with get().
        same = F.filter(runs, lambda r, k: F.coalesce(r["w"] == F.get(runs, k - 1)["w"], F.lit(False)) | F.coalesce(r["w"] == F.get(runs, k + 1)["w"], F.lit(False)))
        return _let(F.transform(same, lambda r: r["at"]), lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, a + (n - 1)))))))

    def runs(ws: Column) -> Column:
        last = F.size(ws) - (n - 1)
        return F.transform(F.slice(ws, 1, F.greatest(last, F.lit(0))), lambda w, k: F.struct(F.concat_ws(" ", w, *[F.get(ws, k + j) for j in range(1, n)]).alias("w"), k.alias("at")))

    return _let(words, lambda ws: F.when(F.size(ws) > n, _let(runs(ws), lambda rs: F.when(F.size(F.array_distinct(F.transform(rs, lambda r: r["w"]))) == F.size(rs), F.lit(0)).otherwise(_let(F.sort_array(rs), marked)))).otherwise(F.lit(0)))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text, each a Column of built-in functions."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(words).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long"),
    }


def ratios(c) -> dict[str, Column]:
    """What rules look at, from counts; c gives the Column of a count by its name."""
    per = lambda a, b: F.when(c(b) == 0, F.lit(0.0)).otherwise(c(a) / c(b))
    return {
        "n_words": c("n_words"),
        "repeat_percent": F.when(c("n_words") == 0, F.lit(0.0)).otherwise(100 * c("n_repeat_words") / c("n_words")),
        "symbols_per_word": per("n_symbols", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
    }


def compile_rules(rules: tuple[Rule, ...], c) -> Column:
    """True where any rule of the table fails."""
    found = ratios(c)
    return reduce(lambda a, b: a | b, (r.fails(found[r.measure]) for r in rules), F.lit(False))


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`keep` columns, the counts, base_failed and kept (no rule of either table fails)."""
    counted = docs.select(*keep, F.struct(*[v.alias(k) for k, v in measures(F.col(text)).items()]).alias("_m"))
    c = lambda name: F.col(f"_m.{name}")
    failed = compile_rules(base, c)
    return counted.select(*keep, "_m.*", failed.alias("base_failed"), (~failed & ~compile_rules(rules, c)).alias("kept"))
