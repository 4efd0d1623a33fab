"""Quality rules: a threshold table compiled into one Spark projection. No Python runs on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space that ends words, symbols that are counted, and frequent function words of four languages.
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the be to of and that have with is in it for was on are as by this a at an or not from "
    "der die das und ist in den von zu mit für auf nicht ein eine des im dem sich auch als "
    "le la les de des et un une en du que est pour dans qui par sur au avec pas "
    "el los las y que una por con para del se no es lo como su al"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``numerator * 1000 / denominator`` has to be at least or at most the bound. A denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    kind: str  # "min" or "max"
    per_mille: int

    def sql(self) -> str:
        """Whether the rule fails, as SQL over the measures; the same text serves Spark and other engines."""
        sign = "<" if self.kind == "min" else ">"
        return f"({self.denominator} > 0 AND 1000 * {self.numerator} {sign} {self.per_mille} * {self.denominator})"


#: The measures are those of ``measures``.
RULES = (
    Rule("mean_word_length_low", "word_chars", "n_words", "min", 2_000),
    Rule("mean_word_length_high", "word_chars", "n_words", "max", 14_000),
    Rule("symbols_per_word", "n_symbols", "n_words", "max", 100),
    Rule("stop_words_per_word", "n_stop_words", "n_words", "min", 60),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", "max", 300),
    Rule("ellipsis_lines_per_line", "n_ellipsis_lines", "n_lines", "max", 300),
    Rule("bullet_lines_per_line", "n_bullet_lines", "n_lines", "max", 900),
)
BASE_SQL = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of a text as columns ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_ellipsis_lines,
    n_bullet_lines`` (long), next to the columns named in ``docs``, which must have other names.

    Words are runs between ASCII white space. A line counts if it has a word. ``n_repeat_words`` counts the words inside 5-word windows
    that occur twice or more, told apart by 64-bit hashes of their words. A null text has no words.
    """
    names = docs.columns
    text = F.coalesce(F.col("__text"), F.lit(""))
    d = docs.withColumn("__text", F.col(text_col))
    d = d.select(*names, text.alias("__text"), F.split(F.translate(text, SPACES, " " * len(SPACES)), " ").alias("__raw"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES + " ", "") != "").alias("__lines"))
    d = d.select(
        *names,
        F.array_remove("__raw", "").alias("__words"),
        (F.length("__text") - F.size("__raw") + 1).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__lines", lambda x: F.endswith(x, F.lit("...")))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("__lines", lambda x: F.substring(x, 1, 2).isin("- ", "* ", "• "))).cast("long").alias("n_bullet_lines"),
    )
    kept = [*names, "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines"]
    size = F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice("__words", F.lit(i + 1), size).alias(f"w{i}") for i in range(WINDOW)))
    d = d.select(*kept, F.size("__words").cast("long").alias("n_words"), F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"), F.transform(shifted, lambda z: F.xxhash64(z)).alias("__windows"))
    kept += ["n_words", "n_stop_words"]
    # Only a text with a repeated window has its windows sorted; equal neighbours are the repeated ones.
    positions = F.sequence(F.lit(0), F.size("__windows") - 1)
    d = d.select(*kept, F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.arrays_zip(F.col("__windows").alias("h"), positions.alias("p")))).alias("__sorted"))
    neighbours = F.zip_with(F.slice("__sorted", F.lit(1), F.size("__sorted") - 1), F.slice("__sorted", F.lit(2), F.size("__sorted") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    d = d.select(*kept, F.sort_array(F.array_distinct(F.flatten(F.array_compact(neighbours)))).alias("__at"))
    steps = F.zip_with(F.slice("__at", F.lit(1), F.size("__at") - 1), F.slice("__at", F.lit(2), F.size("__at") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return d.select(*kept, F.coalesce(F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda total, x: total + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of every text, ``base_failed``, ``failed_rules`` (array of names) and ``kept``.

    ``kept`` is false if ``base_failed``, else true if no rule fails. A null or empty text has no words and so fails the base. Null ids and
    repeated rows stay as they are; other columns are left out. An empty table gives an empty result. Very long texts are measured whole.
    """
    d = measures(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__own_text")), "__own_text")
    failed = F.array_compact(F.array(*(F.when(F.expr(r.sql()), F.lit(r.name)) for r in rules)))
    return d.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", F.expr(BASE_SQL).alias("base_failed"), failed.alias("failed_rules"), (~F.expr(BASE_SQL) & ~F.expr(" OR ".join(r.sql() for r in rules))).alias("kept"))
