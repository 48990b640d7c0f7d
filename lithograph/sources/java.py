"""Java sources as rows of the code model.

Spark does the structure: a regular expression makes tokens, running sums over each file give lines and nesting, windows
give each token its block, its type and its member, and a join gives each method the fields that stand before it.
What is left for Python is the inside of one member: a header of a few tokens and the names in one body.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.functions.scalars import entity_id, package_name, package_parent
from lithograph.operators import catalog
from lithograph.operators.state import cut
from lithograph.sources import syntax

#: Comments, text blocks, strings, characters, names, numbers, operators of two and more signs, line ends, any other sign.
#: Possessive, as Java's matcher would else go one call deeper for each escape.
TOKEN = (
    r"/\*[\s\S]*?\*/|//[^\n]*|" + '"""[\\s\\S]*?"""|' + r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"
    r"[\p{L}_$][\p{L}\p{N}_$]*|\.?\d[\w.]*|->|::|&&|\|\||\+\+|--|>>>=|<<=|>>=|[-+*/%&|^!=<>]=|\.\.\.|\n|\S"
)
#: Fixed values of the language.
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non".split())
KEYWORDS = frozenset("if for while switch catch return new synchronized throw assert else do try case instanceof super this".split())
ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all .java files below a folder; ValueError where it isn't there.

    Names that begin with _ or . are left out, as Spark's file sources do.  Files that can't be read are skipped.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"no such folder: {root}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").option("ignoreCorruptFiles", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").cast("string").alias("content"))


def tokens(files: DataFrame) -> DataFrame:
    """(path, k, line, tok, lvl, paren): each file's tokens but comments; a brace has the level of the block that it bounds."""
    raw = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(f"({TOKEN})"))).alias("k", "tok"))
    file = Window.partitionBy("path").orderBy("k")
    breaks = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    code = raw.withColumn("line", 1 + F.sum(breaks).over(file) - breaks).where("tok <> '\n' and not startswith(tok, '//') and not startswith(tok, '/*')")
    step = lambda a, b: F.when(F.col("tok") == a, 1).when(F.col("tok") == b, -1).otherwise(0)
    depth, paren = F.sum(step("{", "}")).over(file), F.sum(step("(", ")")).over(file)
    return code.withColumn("lvl", depth + (F.col("tok") == "}").cast("int")).withColumn("paren", paren)


# --- the inside of a member --------------------------------------------------------------------------------------


def _text(toks: list[str]) -> str:
    """Tokens as source text: blanks between names and after commas."""
    out = ""
    for t in toks:
        if out and (t[0].isalnum() or t[0] in "_$?") and (out[-1].isalnum() or out[-1] in "_$,?"):
            out += " "
        out += t
    return out


def _balanced(toks: list[str], i: int, a: str, b: str) -> int:
    """The place after the sign that closes the one at i."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j] == a) - (toks[j] == b)
        if depth == 0:
            return j + 1
    return len(toks)


def _split(toks: list[str]) -> list[list[str]]:
    """The parts between commas outside of all brackets."""
    out, depth = [[]], 0
    for t in toks:
        depth += (t in "(<[{") - (t in ")>]}")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _declared(toks: list[str]) -> tuple[list[str], list[str]]:
    """(modifiers, the rest) of a declaration, annotations and its own type parameters left out."""
    mods, i = [], 0
    while i < len(toks):
        if toks[i] == "@" and toks[i + 1 : i + 2] != ["interface"]:
            i += 2
            while toks[i : i + 1] == ["."]:
                i += 2
            if toks[i : i + 1] == ["("]:
                i = _balanced(toks, i, "(", ")")
        elif toks[i] in MODIFIERS:
            mods.append(toks[i])
            i += 1
        elif toks[i] == "<":
            i = _balanced(toks, i, "<", ">")
        else:
            break
    return mods, toks[i:]


def _type_names(toks: list[str]) -> list[str]:
    """The simple names of a list of types; a part without a name gives none."""
    names = [[t for t in (x[: x.index("<")] if "<" in x else x) if t.isidentifier()] for x in _split(toks)]
    return [n[-1] for n in names if n]


def type_header(toks: list[str]) -> dict | None:
    """kind, name, modifiers, super_class and interfaces of a type's header; None for anything else."""
    mods, rest = _declared(toks)
    if len(rest) < 2 or rest[0] not in ("class", "interface", "enum"):
        return None
    tail = rest[2:]
    if tail[:1] == ["<"]:
        tail = tail[_balanced(tail, 0, "<", ">") :]
    lists = {"extends": [], "implements": [], "permits": []}
    at = None
    for t in tail:
        if t in lists:
            at = t
        elif at:
            lists[at].append(t)
    supers, faces = _type_names(lists["extends"]), _type_names(lists["implements"])
    if rest[0] == "enum":
        supers = faces = []
    return {"kind": rest[0].upper(), "name": rest[1], "modifiers": " ".join(mods), "super_class": supers[0] if supers else None, "interfaces": faces}


def member_rows(toks: list[str], lines: list[int], type_name: str, type_fqn: str) -> Iterator[dict]:
    """The field, method and relationship rows of one member of a type."""
    mods, rest = _declared(toks)
    skip = len(toks) - len(rest)
    if not rest or rest[0] in ("class", "interface", "enum", "record", "@", "{", ";", "}"):
        return
    stop = next((i for i, t in enumerate(rest) if t in ("=", "(", "{", ";")), len(rest))
    modifiers = " ".join(mods)
    if rest[stop : stop + 1] == ["("]:
        yield from _method_rows(rest, lines[skip:], lines[0], stop, modifiers, type_name, type_fqn)
    elif stop > 1 and rest[stop : stop + 1] != ["{"]:
        body = rest[:-1] if rest[-1] == ";" else rest
        parts = _split(body)
        head = parts[0][: parts[0].index("=")] if "=" in parts[0] else parts[0]
        while head and head[-1] == "]":
            head = head[:-2]
        kind = head[:-1]
        while kind[-2:] == ["[", "]"]:
            kind = kind[:-2]
        if not kind:
            return  # enum constants
        for i, part in enumerate(parts):
            name = head[-1] if i == 0 else part[0]
            init = _text(part[part.index("=") + 1 :])[:200] if "=" in part else None
            yield {"row": "field", "name": name, "type": _text(kind), "modifiers": modifiers, "initializer": init, "start_line": lines[0]}


def _method_rows(rest, lines, first_line, stop, modifiers, type_name, type_fqn) -> Iterator[dict]:
    name, kind = rest[stop - 1], rest[: stop - 1]
    if not name.isidentifier() or (not kind and name != type_name) or kind[-1:] == [","]:
        return  # enum constants, or an initializer's call
    close = _balanced(rest, stop, "(", ")")
    params = []
    for part in _split(rest[stop + 1 : close - 1]):
        part = _declared(part)[1]
        dims = []
        while part and part[-1] == "]":
            part, dims = part[:-2], [*dims, "[", "]"]
        if len(part) > 1 and part[-1] != "this":
            params.append((_text([t for t in part[:-1] if t != "..."] + dims), part[-1]))
    simple = name if kind else "<init>"
    fqn = f"{type_fqn}.{simple}({','.join(p for p, _ in params)})"
    body = rest[rest.index("{", close) :] if "{" in rest[close:] else []
    decisions = sum(rest.count(t) for t in ("if", "for", "while", "catch", "case", "&&", "||"))
    decisions += sum(t == "default" and rest[i + 1 : i + 2] in ([":"], ["->"]) for i, t in enumerate(rest))
    decisions += sum(t == "?" and rest[i - 1] not in ("<", ",") for i, t in enumerate(rest))
    yield {
        "row": "method", "name": simple, "fqn": fqn, "type": _text(kind) if kind else "void", "parameters": params, "modifiers": modifiers, "start_line": first_line, "end_line": lines[-1],
        "complexity": 1 + decisions, "hash": hashlib.sha256(" ".join(body).encode()).hexdigest()[:16] if body else None,
    }
    yield from _uses(body, lines[len(rest) - len(body) :], fqn, type_fqn)


def _scope_start(body: list[str], i: int) -> int:
    """Where the expression begins that ends before the dot at i."""
    j = i - 1
    while j >= 0:
        if body[j] in (")", "]"):
            a, b = ("(", ")") if body[j] == ")" else ("[", "]")
            depth = 0
            while j >= 0:
                depth += (body[j] == b) - (body[j] == a)
                if depth == 0:
                    break
                j -= 1
            if j > 0 and (body[j - 1].isidentifier() and body[j - 1] not in KEYWORDS - {"this", "super"} or body[j - 1] in (")", "]", ">")):
                j -= 1
                continue
        if j > 0 and body[j - 1] == ".":
            j -= 2
        elif j > 0 and body[j - 1] == "new":
            return j - 1
        else:
            return j
    return 0


def _ends_type(body: list[str], i: int) -> bool:
    """Whether the > at i closes type arguments: nothing but types stands between it and its <."""
    depth = 0
    for j in range(i, -1, -1):
        depth += (body[j] == ">") - (body[j] == "<")
        if depth == 0:
            return True
        if not (body[j].isidentifier() or body[j] in "<>,.?&[]@"):
            return False
    return False


def _uses(body: list[str], lines: list[int], method: str, type_fqn: str) -> Iterator[dict]:
    """Calls, writes by this and names that may be fields in a body; a bag, one row for each occurrence."""
    made = lambda kind, to, line: {"row": "relationship", "source": method, "target": to, "kind": kind, "start_line": line}
    for i, t in enumerate(body):
        if not t.isidentifier():
            continue
        before, after = body[i - 1] if i else "", body[i + 1] if i + 1 < len(body) else ""
        if after == "(" and t not in KEYWORDS:
            if before == ".":
                start = _scope_start(body, i - 1)
                if body[start] == "new" and "(" not in body[start : i - 1]:
                    continue  # a qualified name of what is made
                scope = _text(body[start : i - 1])
                to = f"{type_fqn}.{t}" if scope in ("this", "super") else f"~{scope}.{t}"
                yield made("CALLS", to, lines[start])
            elif before != "new" and not (before.isidentifier() and before not in KEYWORDS | {"else", "do"}):
                yield made("CALLS", f"{type_fqn}.{t}", lines[i])
            continue
        typed = (before.isidentifier() and before not in KEYWORDS) or before == "]" or (before == ">" and _ends_type(body, i - 1))
        if after in ASSIGNS and before == "." and body[i - 2 : i - 1] == ["this"] and body[i - 3 : i - 2] != ["."]:
            yield made("WRITES_FIELD", f"{type_fqn}.{t}", 0)
        if t not in KEYWORDS and before not in (".", "::", "new", "@") and not typed and after != "->":
            for kind in ("WRITES_FIELD", "READS_FIELD") if after in ASSIGNS else ("READS_FIELD",):
                yield made(kind, f"{type_fqn}.{t}", 0) | {"row": "use", "name": t}


# --- the tables --------------------------------------------------------------------------------------------------

_HEADER = "path string, open int, kind string, name string, modifiers string, super_class string, interfaces array<string>"
_MEMBER = (
    "path string, open int, member long, row string, name string, fqn string, type string, parameters array<struct<type:string,name:string>>, modifiers string, initializer string, "
    "start_line int, end_line int, complexity int, hash string, source string, target string, kind string, n int"
)


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """packages, types, fields, methods and relationships of (path, content), each with ord, and files (path, ok).

    Rows as the scan finds them: a name that occurs twice is there twice, and a snapshot keeps the last.  Files
    with errors give no rows.  Null or empty content gives no rows and is no error.
    """
    every = cut(tokens(files))
    # a row a file, which every table asks for: the check of all tokens runs once
    status = cut(syntax.parsed(files, every))
    code = every.join(status.where("ok").select("path"), "path", "left_semi")
    file = Window.partitionBy("path").orderBy("k")
    # statements end at ; { } outside parentheses; a block's header is the statement that its brace ends
    bound = (F.col("tok").isin(";", "{", "}") & (F.col("paren") == 0)).cast("int")
    code = code.withColumn("statement", F.sum(bound).over(file) - bound)
    packages = (
        code.where("lvl = 0").groupBy("path", "statement").agg(F.array_sort(F.collect_list(F.struct("k", "tok"))).alias("s")).select("path", F.transform("s", lambda x: x["tok"]).alias("s"))
    )
    packages = packages.where("s[0] = 'package'").select("path", F.array_join(F.slice("s", 2, F.size("s") - 2), "").alias("package"))
    level = Window.partitionBy("path", "lvl").orderBy("k")
    opened = F.last(F.when(F.col("tok") == "{", F.col("k")), ignorenulls=True).over(level)
    braces = code.where("tok in ('{', '}')").withColumn("open", opened)
    pairs = braces.groupBy("path", "open").agg(F.max("k").alias("close"), F.max("line").alias("end_line"), F.min_by("statement", "k").alias("statement"))
    spoken = code.where("tok in ('class', 'interface', 'enum')").select("path", "statement").distinct()
    heads = code.join(pairs.join(spoken, ["path", "statement"], "left_semi").select("path", "statement", "open"), ["path", "statement"]).where("k < open")
    heads = heads.groupBy("path", "open").agg(F.array_sort(F.collect_list(F.struct("k", "tok"))).alias("s"), F.min_by("line", "k").alias("start_line"))

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "open": o, **h} for p, o, s in zip(pdf["path"], pdf["open"], pdf["s"]) if (h := type_header(list(s)))]
            yield pd.DataFrame(rows, columns=["path", "open", "kind", "name", "modifiers", "super_class", "interfaces"])

    found = heads.select("path", "open", F.transform("s", lambda x: x["tok"]).alias("s")).mapInPandas(headers, _HEADER)
    types = found.join(heads.select("path", "open", "start_line"), ["path", "open"]).join(pairs.select("path", "open", "close", "end_line"), ["path", "open"])
    package = F.coalesce("package", F.lit(""))
    fqn = F.when(package == "", F.col("name")).otherwise(F.concat(package, F.lit("."), F.col("name")))
    # a row a type, read by every table too
    types = cut(types.join(packages, "path", "left").withColumn("package_fqn", package).withColumn("fqn", fqn))

    # each token's type is the innermost around it; a type's own braces are its parent's, and end a member there
    inside = code.join(types.select("path", "open", "close", "name", "fqn"), "path").where("k > open and k < close")
    inner = inside.groupBy("path", "k", "line", "tok", "lvl", "paren").agg(F.max_by(F.struct("open", "name", "fqn"), "open").alias("t")).select("path", "k", "line", "tok", "lvl", "paren", "t.*")
    own = Window.partitionBy("path", "open").orderBy("k")
    top = inner.withColumn("base", F.first("lvl").over(own)).withColumn("base", F.least("base", F.min("lvl").over(Window.partitionBy("path", "open"))))
    follow = F.lead("tok").over(own)
    done = ((F.col("tok") == ";") & (F.col("lvl") == F.col("base")) & (F.col("paren") == 0)) | (
        (F.col("tok") == "}") & (F.col("lvl") == F.col("base") + 1) & (F.col("paren") == 0) & ~F.coalesce(follow, F.lit("")).isin(";", ",", ".", ")")
    )
    marked = top.withColumn("done", done.cast("int")).withColumn("member", F.sum("done").over(own) - F.col("done"))
    members = marked.groupBy("path", "open", "name", "fqn", "member").agg(F.array_sort(F.collect_list(F.struct("k", "tok", "line"))).alias("s"))

    columns = [c.strip().split(" ")[0] for c in _split_schema(_MEMBER)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for n, row in enumerate(member_rows(list(r.toks), list(r.lines), r.name, r.fqn)):
                    out.append({"path": r.path, "open": r.open, "member": r.member, "n": n, **row})
            # columns of objects: pandas would make floats of missing values
            yield pd.DataFrame({c: pd.Series([x.get(c) for x in out], dtype=object) for c in columns})

    plain = members.select("path", "open", "name", "fqn", "member", F.transform("s", lambda x: x["tok"]).alias("toks"), F.transform("s", lambda x: x["line"].cast("int")).alias("lines"))
    found_rows = cut(plain.mapInPandas(rows, _MEMBER))
    fields = found_rows.where("row = 'field'")
    # a method sees the fields of its type that stand before it
    since = fields.groupBy("path", "open", "name").agg(F.min("member").alias("since"))
    seen = found_rows.where("row = 'use'").join(since, ["path", "open", "name"]).where(F.col("since") < F.col("member"))
    place = types.select("path", "open", F.col("fqn").alias("declaring_type_fqn"))
    order = F.struct("path", "open", "member", "n").alias("ord")
    methods = found_rows.where("row = 'method'").join(place, ["path", "open"])
    uses = found_rows.where("row = 'relationship'").unionByName(seen.select(found_rows.columns))
    inherits = types.select("path", "open", "fqn", F.explode(F.concat(F.when(F.col("super_class").isNotNull(), F.array(F.struct(F.col("super_class").alias("to"), F.lit("EXTENDS").alias("kind")))).otherwise(F.array().cast("array<struct<to:string,kind:string>>")), F.transform("interfaces", lambda i: F.struct(i.alias("to"), F.lit("IMPLEMENTS").alias("kind"))))).alias("r"))
    relationships = uses.select(F.col("source").alias("from_entity_fqn"), F.col("target").alias("to_entity_fqn"), "kind", F.col("start_line").alias("source_line"), order).unionByName(
        inherits.select(F.col("fqn").alias("from_entity_fqn"), F.col("r.to").alias("to_entity_fqn"), F.col("r.kind").alias("kind"), F.lit(0).alias("source_line"), F.struct("path", "open", F.lit(-1).cast("long").alias("member"), F.lit(0).alias("n")).alias("ord"))
    )
    return {
        "files": status,
        "declared": packages.select("path", F.col("package").alias("fqn")),
        "packages": package_rows(packages.select(F.col("package").alias("fqn")), types, files),
        "types": types.select(
            F.col("fqn").alias("id"), "fqn", F.col("name").alias("simple_name"), "package_fqn", "kind", "modifiers", "super_class", "interfaces", F.col("path").alias("source_file"), F.col("start_line").cast("int").alias("start_line"),
            F.col("end_line").cast("int").alias("end_line"), (F.col("end_line") - F.col("start_line") + 1).cast("int").alias("line_count"), F.lit(0).alias("field_count"), F.lit(0).alias("method_count"), F.struct("path", "open", F.lit(0).cast("long").alias("member"), F.lit(0).alias("n")).alias("ord"),
        ),
        "fields": fields.join(place, ["path", "open"]).withColumn("fqn", F.concat("declaring_type_fqn", F.lit("."), "name")).select(
            F.col("fqn").alias("id"), "fqn", F.col("name").alias("simple_name"), "declaring_type_fqn", F.col("type").alias("field_type"), "modifiers", "initializer", "start_line", order
        ),
        "methods": methods.select(
            F.col("fqn").alias("id"), "fqn", F.col("name").alias("simple_name"), "declaring_type_fqn", F.col("type").alias("return_type"), "parameters", "modifiers", "start_line", "end_line", F.col("complexity").alias("cyclomatic_complexity"), F.col("hash").alias("body_hash"), order
        ),
        "relationships": relationships.select(entity_id("from_entity_fqn", "to_entity_fqn", "kind", "source_line", F.to_json("ord")).alias("id"), "from_entity_fqn", "to_entity_fqn", "kind", "source_line", "ord"),
    }


def package_rows(declared: DataFrame, types: DataFrame, files: DataFrame) -> DataFrame:
    """The packages that files declare (fqn, a row a file), with the numbers of their types (package_fqn) and files (path)."""
    type_counts = types.groupBy(F.col("package_fqn").alias("fqn")).agg(F.count("*").cast("int").alias("type_count"))
    return catalog.package_file_counts(declared.select("fqn"), files.select("path")).join(type_counts, "fqn", "left").select(
        F.col("fqn").alias("id"), "fqn", package_name("fqn").alias("name"), package_parent("fqn").alias("parent_fqn"), F.col("file_count").cast("int").alias("file_count"), F.coalesce("type_count", F.lit(0)).alias("type_count")
    )


def _split_schema(schema: str) -> list[str]:
    """The columns of a schema string, by the commas outside its brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
