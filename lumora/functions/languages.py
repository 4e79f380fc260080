"""Scores of programming languages and tokens of program text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, shape and imports of each language, in the order that decides ties.
WORDS = {
    "python": "def class import from if elif else for while try except finally with lambda yield async await print return pass continue break raise assert del and or not in is as",
    "java": "public private protected class interface enum extends implements static final void return if else for while switch case try catch finally throw throws new this super import package",
    "javascript": "function var let const if else for while switch case try catch finally throw return async await export import class extends super this new undefined null typeof instanceof",
    "cpp": "#include using namespace class struct public private protected virtual override const static template typename auto decltype if else for while switch case return try catch throw new delete this nullptr true false",
    "csharp": "public private protected internal class struct interface enum namespace using static readonly virtual override abstract sealed if else for foreach while switch case return try catch finally throw new this base null true false var async await",
    "go": "package import func var const type struct interface map chan go defer range select if else for switch case return break continue fallthrough default goto nil make len cap",
    "rust": "fn let mut const static struct enum impl trait pub use mod crate self super as match if else for while loop return break continue unsafe move async await yield dyn box ref",
}
SHAPES = {
    "python": r"def\s+\w+.*:|class\s+\w+.*:|import\s+\w+|from\s+\w+\s+import",
    "java": r"public\s+class\s+\w+|private\s+\w+|public\s+static\s+void\s+main",
    "javascript": r"function\s+\w+.*\{|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=|class\s+\w+",
    "cpp": r"#include\s*<.*>|using\s+namespace|class\s+\w+|struct\s+\w+|template\s*<.*>",
    "csharp": r"namespace\s+\w+|using\s+\w+;|public\s+class\s+\w+|private\s+\w+",
    "go": r"package\s+\w+|func\s+\w+.*\{|var\s+\w+|const\s+\w+=|type\s+\w+",
    "rust": r"fn\s+\w+.*\{|struct\s+\w+|enum\s+\w+|impl\s+\w+|trait\s+\w+|pub\s+fn|let\s+mut",
}
IMPORTS = {
    "python": (r"import\s+\w+", r"from\s+\w+\s+import"),
    "java": (r"import\s+[\w.]+\*?;", r"package\s+[\w.]+;"),
    "javascript": (r"import\s+.*from|require\(|module\.exports\s*=|\bexport\b",),
    "cpp": (r"#include\s*[<\"]",),
    "csharp": (r"using\s+[\w.]+;",),
    "go": (r"import\s*\(", r"import\s+[\w.]+"),
    "rust": (r"use\s+[\w:]+",),
}
EXTENSIONS = {
    "python": ("py", "pyw", "pyc"), "java": ("java",), "javascript": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "cpp": ("cpp", "cc", "cxx", "h", "hpp", "hxx", "hh"),
    "csharp": ("cs",), "go": ("go",), "rust": ("rs",),
}
ALIASES = {"py": "python", "js": "javascript", "c++": "cpp", "cs": "csharp", "ts": "javascript", "tsx": "javascript", "jsx": "javascript"}
#: Token classes of five languages, their keywords, names and comments, and the keywords of two groups.
TOKENS = {"operators": r"[+\-*/%=<>!&|^~]", "delimiters": r"[(){}\[\].,;:]", "numbers": r"\b\d+\.?\d*\b", "whitespace": r"\s+"}
KEYWORDS = {
    "python": "and as assert break class continue def del elif else except exec finally for from global if import in is lambda not or pass print raise return try while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield",
    "cpp": "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t class compl const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
}
NAMES = {"python": r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", "java": r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", "javascript": r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", "cpp": r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", "csharp": r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"}
COMMENTS = {"python": r"(?s)#.*", "java": r"(?s)//.*|/\*.*?\*/", "javascript": r"(?s)//.*|/\*.*?\*/", "cpp": r"(?s)//.*|/\*.*?\*/", "csharp": r"(?s)//.*|/\*.*?\*/"}
CONTROL, DEFINING = ("if", "else", "elif", "for", "while", "break", "continue", "return"), ("def", "class", "lambda", "import", "from")
#: The tokens whose frequencies make the token vector.
VECTOR = "def class import from if elif else for while try except finally with as return yield lambda and or not in is None True False self print len range enumerate zip map filter sorted list dict set tuple str int float bool"
#: Words of six formal comments.
FORMAL = ("function", "method", "class", "parameter", "returns", "raises")


def distinct_words(text: Column) -> Column:
    """The distinct words in lower case, for scores of all languages: the text is cut once instead of searched a word."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def words_found(text: Column, words: Column, language: str) -> Column:
    """How many of the language's words the text has."""
    keys = WORDS[language].split()
    plain = [k for k in keys if k.isalnum()]
    found = F.size(F.array_intersect(words, F.array(*map(F.lit, plain))))
    for k in keys:
        if not k.isalnum():  # a mark inside: the boundary before it needs a letter there
            found = found + text.rlike(rf"(?i)\b{k}\b").cast("int")
    return found


def score(text: Column, words: Column, language: str) -> Column:
    """0.5 x share of the language's words + 0.3 x matches of its shape (10 are enough) + 0.2 x import forms (5 are enough)."""
    found, keys = words_found(text, words, language), WORDS[language].split()
    shape = F.regexp_count(text, F.lit("(?id)" + SHAPES[language]))
    imports = sum((text.rlike("(?d)" + p).cast("int") for p in IMPORTS[language]), F.lit(0))
    return F.round(found / len(keys) * 0.5 + F.least(shape / 10, F.lit(1.0)) * 0.3 + F.least(imports / 5, F.lit(1.0)) * 0.2, 9)


def scores(text: Column, words: Column) -> dict[str, Column]:
    return {language: score(text, words, language) for language in WORDS}


def best(columns: dict[str, Column]) -> Column:
    """(language, confidence) of the largest score; the earlier language wins a tie."""
    return F.array_max(F.array(*[F.struct(c.alias("confidence"), F.lit(-i).alias("rank"), F.lit(n).alias("language")) for i, (n, c) in enumerate(columns.items())]))


def statistics(text: Column, words: Column) -> Column:
    """An array of (language, confidence, keywords_found, pattern_matches), a struct a language; shapes are counted as they are written, case and all."""
    each = [
        F.struct(
            F.lit(n).alias("language"), score(text, words, n).alias("confidence"), words_found(text, words, n).cast("long").alias("keywords_found"),
            F.regexp_count(text, F.lit("(?d)" + SHAPES[n])).cast("long").alias("pattern_matches"),
        )
        for n in WORDS
    ]
    return F.array(*each)


def top(columns: dict[str, Column], n: int = 3) -> Column:
    """The n largest scores as (confidence, rank, language), largest first; the earlier language wins a tie."""
    each = [F.struct(c.alias("confidence"), F.lit(-i).alias("rank"), F.lit(name).alias("language")) for i, (name, c) in enumerate(columns.items())]
    return F.slice(F.sort_array(F.array(*each), asc=False), 1, n)


def hinted(text: Column, path: Column, columns: dict[str, Column]) -> Column:
    """(language, confidence) with a file's name as a hint: its extension's language counts if its score is over 0.3.

    Otherwise the largest score from 0.2 on, else unknown and 0; so too for a blank or null text. A null path gives no hint.
    """
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    pair = lambda name, c: F.struct(name.alias("language"), c.alias("confidence"))
    first, unknown = best(columns), pair(F.lit("unknown"), F.lit(0.0))
    out = F.when(first["confidence"] >= 0.2, pair(first["language"], first["confidence"])).otherwise(unknown)
    for name, suffixes in EXTENSIONS.items():
        out = F.when(suffix.isin(*suffixes) & (columns[name] > 0.3), pair(F.lit(name), columns[name])).otherwise(out)
    return F.when(text.isNull() | ~text.rlike(r"\S"), unknown).otherwise(out)


def validate(text: Column, chosen: Column, top: Column) -> Column:
    """valid, mismatch or unclear: a choice against the best language; under 20 characters any choice holds."""
    name = F.lower(chosen)
    for a, b in ALIASES.items():
        name = F.when(F.lower(chosen) == a, b).otherwise(name)
    return F.when(text.isNull() | (F.length(F.trim(text)) < 20), "valid").when(F.when(top["confidence"] > 0.1, top["language"]).otherwise("unknown") == name, "valid").when(F.when(top["confidence"] > 0.1, top["confidence"]).otherwise(F.lit(0.0)) > 0.08, "mismatch").otherwise("unclear")


def tokens(text: Column, kind: str, language: str) -> Column:
    """All tokens of a class: keywords, identifiers, comments, or one of TOKENS."""
    patterns = {"keywords": r"\b(?:" + KEYWORDS[language].replace(" ", "|") + r")\b", "identifiers": NAMES[language], "comments": COMMENTS[language], **TOKENS}
    unicode = "(?U)" if kind in ("keywords", "identifiers", "numbers") else ""  # a word ends where letters of any script end
    return F.regexp_extract_all(text, F.lit(unicode + patterns[kind]), F.lit(0))


def semantic(keywords: Column, names: Column) -> dict[str, Column]:
    """Sizes of the groups that keywords and names fall into."""
    is_function = lambda x: x.startswith("def_") | x.endswith("_func")
    is_type = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    size = lambda a, f: F.size(F.filter(a, f)).cast("long")
    return {
        "control_flow": size(keywords, lambda x: x.isin(*CONTROL)),
        "functions": size(keywords, lambda x: x.isin(*DEFINING)) + size(names, is_function),
        "data_types": size(names, lambda x: ~is_function(x) & is_type(x)),
        "variables": size(names, lambda x: ~is_function(x) & ~is_type(x)),
    }


def vector_tokens(text: Column) -> Column:
    """The text's tokens that are in the vector, as often as they come."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), lambda x: x.isin(*VECTOR.split()))


def latin_chars(text: Column) -> Column:
    """The text's characters below code point 256, as often as they come."""
    return F.filter(F.split(text, ""), lambda c: (c != "") & (c <= "\u00ff"))


def machine_signals(text: Column, lines: Column) -> dict[str, Column]:
    """Eight marks of generated Python text, as shares."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*="), F.lit(1))
    notes = F.filter(lines, lambda x: x.rlike(r"^\s*#"))
    formal = F.filter(notes, lambda x: F.lower(x).rlike("|".join(FORMAL)))
    sizes = F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(x).cast("double"))
    n = F.size(sizes)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(sizes) / n
    spread = F.sqrt(F.greatest(total(F.transform(sizes, lambda x: x * x)) / n - mean * mean, F.lit(0.0)))
    heads = F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*(?:import|from) "), i).otherwise(-1))
    last = F.array_max(heads)
    return {
        "verbose_variables": over(count(r"\b[a-z_]+_[a-z_]+_[a-z_]+\b"), F.size(names)),
        "type_hints": over(count(r":\s*(?:int|str|float|bool|List|Dict|Optional|Any|Union|Tuple)\s*[=)]"), count(r"\bdef\s+\w+")),
        "docstrings": over(count(r'(?s)""".*?"""') + count("(?s)'''.*?'''"), count(r"\bdef\s+\w+") + count(r"\bfunction\s+\w+")),
        "formal_comments": over(F.size(formal), F.size(notes)),
        "name_length": F.when(F.size(names) > 0, total(F.transform(names, lambda x: F.length(x).cast("double"))) / F.size(names)).otherwise(F.lit(0.0)),
        "long_names": over(F.size(F.filter(names, lambda x: F.length(x) > 12)), F.size(names)),
        "line_length_cv": F.when(n > 0, spread / F.greatest(mean, F.lit(1.0))).otherwise(F.lit(0.0)),
        "imports_on_top": F.when((last >= 0) & (last < F.size(lines) * 0.1), 1.0).otherwise(0.0),
    }
