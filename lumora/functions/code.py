"""Columns of features from a column of program text; none leaves the JVM or moves a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the structural counts look for.
MARKS = ("def ", "class ", "import ", "if ", "for ", "while ", "try:", "except", "return ", "yield ", "lambda ")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def word_count(text: Column, word: str) -> Column:
    return count(text, rf"\b{word}\b")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b to six places; otherwise where b is zero."""
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(otherwise))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def filled(lines: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(lines, lambda x: x.rlike(r"\S"))


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def occurrences(text: Column, piece: str) -> Column:
    """How often a fixed piece occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def comment_counts(lines: Column) -> Column:
    """(comment, doc, inline): a line that opens with three quotes turns the documentation state over, whatever follows."""
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("comment"), F.lit(0).alias("doc"), F.lit(0).alias("inline"))

    def step(acc, line):
        turns = line.rlike(r"""^\s*(\"\"\"|''')""")
        within = turns | acc["open"]
        opens = line.rlike(r"^\s*#")
        return F.struct(
            (acc["open"] != turns).alias("open"),
            (acc["comment"] + (~within & opens).cast("int")).alias("comment"),
            (acc["doc"] + within.cast("int")).alias("doc"),
            (acc["inline"] + (~within & ~opens & line.contains("#")).cast("int")).alias("inline"),
        )

    return F.aggregate(lines, start, step)


def bracket_depth(text: Column) -> Column:
    """The deepest nesting of brackets; a closing one too many is ignored."""
    only = F.regexp_replace(text, r"[^(){}\[\]]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = F.when(c == "", acc["now"]).when(c.isin("(", "{", "["), acc["now"] + 1).otherwise(F.greatest(acc["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(only, ""), start, step, lambda acc: acc["most"].cast("long"))


def snake(names: Column) -> Column:
    """The number of names with an underscore and no capital."""
    return F.size(F.filter(names, lambda x: x.contains("_") & (F.lower(x) == x) & x.rlike("[a-z]")))


def code_type(text: Column) -> Column:
    """The kind of a sample, by the first rule that fits."""
    low = F.lower(text)

    def has(*pieces: str) -> Column:
        out = low.contains(pieces[0])
        for p in pieces[1:]:
            out = out | low.contains(p)
        return out

    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(has("class ", "struct ", "interface "), "class_definition")
        .when(has("def ", "function ", "fn ", "public "), "function")
        .when(has("import", "#include"), "import_statement")
        .when(has("main", "entry"), "main_function")
        .when(has("#") & has("def"), "python_function")
        .when(has("{") & has("function"), "javascript_function")
        .otherwise("other")
    )


def in_order(text: Column, anchors: list[str]) -> Column:
    """Whether the anchors occur one after the other, each from where the one before ended; linear in the text."""
    rest = text
    found = F.lit(True)
    for a in anchors:
        found = found & rest.rlike(a)
        rest = F.regexp_replace(rest, rf"^(?s:.*?)(?:{a})", "")
    return found


def readability(words: Column, sentences: Column, syllables: Column) -> tuple[Column, Column]:
    """Flesch reading ease and Flesch-Kincaid grade; 0 without words."""
    ease = 206.835 - 1.015 * words / sentences - 84.6 * syllables / words
    grade = 0.39 * words / sentences + 11.8 * syllables / words - 15.59
    return F.when(words > 0, ease).otherwise(F.lit(0.0)), F.when(words > 0, grade).otherwise(F.lit(0.0))
