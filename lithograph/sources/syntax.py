"""Syntax errors of Java files, found on their tokens by Spark: what can't stand side by side, brackets that don't match, blocks that don't end.

Each token has a class; a table of rules says which classes never follow one another and what must follow some words.  Running
sums give each bracket its depth and the bracket that it closes, and each brace the kind of body that it opens.  Windows
do all of it, so nesting may be as deep as the file is long.  A rule only names what no valid file has; a file without a
finding may still be wrong in types, names or the order of longer phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the language: its reserved words but those that stand for values and types, then these.
RESERVED = (
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected "
    "public return static strictfp switch synchronized throw throws transient try volatile while"
).split()
PRIMITIVES = "boolean byte char double float int long short void".split()
VALUES = "true false null".split()
#: Words that are reserved in some places only, and may stand beside names there.
CONTEXTUAL = "record sealed non permits var yield when module open requires transitive exports opens to uses provides with".split()
BINARY = "= += -= *= /= %= &= |= ^= <<= >>= >>>= == != <= >= && || / % ^ |".split()

#: (classes, classes that never follow them).  Class `name` is any other word, `lit` a literal, `prim` a primitive type; a reserved word or a sign is a class of its own.
NEVER = (
    (BINARY, [*"; ) ] } , * ? : . > & -> ::".split(), *BINARY]),
    ([*"{ ( [ ; , : ? -> ! ~ < &".split(), *"return throw case else do new assert if while for switch".split()], BINARY),
    (["->"], "; ) ] } , ? : . -> ::".split()),
    (["!", "~", "+", "-"], "; ) ] } , ? : . -> ::".split()),
    (["*"], ") ] } ,".split()),
    (["&"], "; ) ] } ,".split()),
    (["<"], "; ) ] } ,".split()),
    (["?"], "; ] } )".split()),
    ([":"], ") ] ,".split()),
    ([","], ") ] ,".split()),
    (["("], ", ] } . : :: ? -> *".split()),
    (["["], "; ) } , . : ? -> ::".split()),
    ([";"], ", ] . ? : -> ::".split()),
    (["{"], ") ] . ? : -> ::".split()),
    (["lit"], ["lit", "name", "prim", "(", "{", "[", "@", "!", "~", *(w for w in RESERVED if w != "instanceof")]),
    (["name"], ["lit"]),
    (["prim"], ["lit", ";", *BINARY]),
    (["throw"], [";"]),
)
#: (word or sign, what must follow it).
FOLLOWS = {
    "extends": ["name", "@"], "implements": ["name", "@"], "throws": ["name", "@"], "package": ["name"], "import": ["name", "static"], "class": ["name"], "interface": ["name"], "enum": ["name"],
    "instanceof": ["name", "prim", "@", "final"], "new": ["name", "prim", "@", "<"], "if": ["("], "while": ["("], "for": ["("], "switch": ["("], "catch": ["("], "finally": ["{"], "try": ["{", "("],
    ".": ["name", "new", "class", "*", "<", "@"], "::": ["name", "new", "<"], "@": ["name", "interface"], "goto": [], "const": [],
}
#: What may precede a word.
PRECEDES = {"else": ["}", ";"], "catch": ["}"], "finally": ["}"]}
_PAIRS = sorted({f"{a} {b}" for left, right in NEVER for a in left for b in right})


def token_class(tok: Column) -> Column:
    word = tok.rlike(r"^[\p{L}_$]")
    return (
        F.when(tok.isin("yield"), "yield").when(tok.isin(*RESERVED), tok).when(tok.isin(*PRIMITIVES), "prim").when(tok.isin(*VALUES) | tok.rlike(r"^\.?[0-9]") | ((F.length(tok) > 1) & tok.rlike("^[\"']")), "lit").when(word, "name").otherwise(tok)
    )


def errors(code: DataFrame) -> DataFrame:
    """(path, k, line, reason) of what is wrong in tokens (path, k, line, tok); a file without rows here has no finding."""
    file = Window.partitionBy("path").orderBy("k")
    rows = code.select("path", "k", "line", "tok", token_class(F.col("tok")).alias("c"))
    opens, closes = F.col("tok").isin("(", "[", "{"), F.col("tok").isin(")", "]", "}")
    rows = rows.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(file) + closes.cast("int"))
    before, two = F.lag("c").over(file), F.lag("c", 2).over(file)
    rows = rows.withColumns({
        "before": before, "two": two, "after": F.lead("c").over(file), "told": F.lag("tok").over(file), "told2": F.lag("tok", 2).over(file),
        # a body's kind shows in what stands before its brace, or before a row of braces
        "lead_in": F.last(F.when(F.col("tok") != "{", F.col("c")), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1)),
        "mark": F.last(F.when(F.col("tok").isin("class", "interface", "enum", ";", "{", "}") & (F.coalesce(before, F.lit("")) != "."), F.col("tok")), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1)),
    })
    brackets = Window.partitionBy("path", "depth").orderBy("k")
    paired = rows.where(opens | closes).select("path", "k", F.lag(F.struct("tok", "lead_in", "mark")).over(brackets).alias("opener"), F.lead("tok").over(brackets).alias("closer"))
    rows = rows.join(paired, ["path", "k"], "left")
    # as one expression: hundreds of literals, each sent to the JVM by itself, take seconds
    pair = F.expr(f"concat_ws(' ', before, c) IN ({', '.join(map(repr, _PAIRS))})")
    plain = ~F.col("tok").isin(*CONTEXTUAL) & ~F.col("told").isin(*CONTEXTUAL) & ~F.col("told2").isin(*CONTEXTUAL)
    array = F.col("opener.lead_in").isin("=", "]", ",", "(", "default")
    ends = F.col("before").isin(";", "}", "{", ":") | ((F.col("opener.mark") == "enum") & F.col("before").isin("name", ")", ","))

    def demanded(word: Column, table: dict, other: Column) -> Column:
        out = F.lit(False)
        for key, allowed in table.items():
            held = (word == key) & ~other.isin(*allowed) if allowed else word == key
            out = out | held
        return out

    # class behind a dot and new behind two colons end an expression
    whole = ((F.col("c") == "class") & (F.col("before") == ".")) | ((F.col("c") == "new") & (F.col("before") == "::"))
    follow = demanded(F.when(~F.coalesce(whole, F.lit(False)), F.col("c")), FOLLOWS, F.coalesce("after", F.lit("")))
    reason = (
        F.when(F.col("tok").isin('"', "'", "#", "`", "\\"), "stray sign")
        .when(closes & F.col("opener").isNull(), "closes nothing")
        .when(closes & ~F.concat("opener.tok", "tok").isin("()", "[]", "{}"), "closes another bracket")
        .when(opens & F.col("closer").isNull(), "is never closed")
        .when(pair, "can't follow what stands before it")
        .when(F.coalesce(follow, F.lit(False)), "is followed by something else than it needs")
        .when(F.coalesce(demanded(F.col("c"), PRECEDES, F.coalesce("before", F.lit(""))), F.lit(False)), "doesn't belong here")
        .when((F.col("c") == "name") & (F.col("before") == "name") & F.col("two").isin("name", "prim") & plain, "one name too many")
        .when((F.col("tok") == "}") & ~array & ~ends, "ends a body in the middle of a statement")
    )
    return rows.select("path", "k", "line", reason.alias("reason")).where("reason is not null")


def parsed(files: DataFrame, code: DataFrame) -> DataFrame:
    """(path, ok) of each file: ok where no error was found."""
    wrong = errors(code).groupBy("path").agg(F.count("*").alias("wrong"))
    return files.select("path").join(wrong, "path", "left").select("path", F.col("wrong").isNull().alias("ok"))
