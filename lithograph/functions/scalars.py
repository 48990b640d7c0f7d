"""Scalar functions of the code model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without_parameters(fqn: Column) -> Column:
    """Up to the first parenthesis, unless that is the first character."""
    return F.when(F.instr(fqn, "(") > 1, F.substring_index(fqn, "(", 1)).otherwise(fqn)


def simple_method_name(fqn) -> Column:
    """`a.b.Foo.bar(int)` -> `bar`."""
    return F.substring_index(_without_parameters(_col(fqn)), ".", -1)


def label(fqn) -> Column:
    """The last two segments without parameters: `a.b.Foo.bar(int)` -> `Foo.bar`."""
    return F.substring_index(_without_parameters(_col(fqn)), ".", -2)


def hot_label(fqn) -> Column:
    """What stands after the last dot, parameters and all."""
    return F.substring_index(_col(fqn), ".", -1)


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def package_name(fqn) -> Column:
    return F.substring_index(_col(fqn), ".", -1)


def package_parent(fqn) -> Column:
    """Up to the last dot; null at the root."""
    fqn = _col(fqn)
    return F.when(fqn.contains("."), F.left(fqn, F.length(fqn) - F.length(package_name(fqn)) - 1))


def initials(name) -> Column:
    """The first letters of the first two words, in upper case."""
    words = F.filter(F.split(_col(name), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.slice(F.transform(words, lambda w: F.left(w, F.lit(1))), 1, 2), ""))


def first_line(message) -> Column:
    return F.coalesce(F.split(F.trim(_col(message)), r"\r?\n", 2)[0], F.lit(""))


def short_hash(commit) -> Column:
    return F.left(_col(commit), F.lit(7))


def cut_off(text, most: int = 200) -> Column:
    return F.left(_col(text), F.lit(most))


def name_distance(a, b) -> Column:
    """Edits between two names, each letter put in, left out or changed costing one."""
    return F.levenshtein(_col(a), _col(b))


def name_similarity(a, b) -> Column:
    """1 - distance / longer length; two empty names are alike."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def body_hash(text) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of a body whose white space is collapsed; null stays null."""
    return F.left(F.sha2(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), 256), F.lit(16))


def signature_reason(name, return1, return2, count1, count2) -> Column:
    """Why two methods of one name have divergent signatures; the wording is a fixed value of the model."""
    name, return1, return2, count1, count2 = map(_col, (name, return1, return2, count1, count2))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    returns = F.when(~return1.eqNullSafe(return2), F.concat(F.lit("return type ("), text(return1), F.lit(" vs "), text(return2), F.lit(") "))).otherwise("")
    counts = F.when(~count1.eqNullSafe(count2), F.concat(F.lit("param count ("), text(count1), F.lit(" vs "), text(count2), F.lit(")"))).otherwise("")
    return F.rtrim(F.concat(F.lit("Method '"), name, F.lit("' has divergent signature: "), returns, counts))


def complexity_bucket(c) -> Column:
    c = _col(c)
    return F.when(c <= 4, "low").when(c <= 10, "medium").otherwise("high")


def churn_bucket(commits) -> Column:
    commits = _col(commits)
    return F.when(commits > 10, "High").when(commits > 3, "Medium").otherwise("Low")


def complexity_bar(c) -> Column:
    return F.least(_col(c) * 5, F.lit(100))


def progress_percent(done, total) -> Column:
    """Whole per cent, at most 100; 0 of nothing."""
    done, total = _col(done).cast("long"), _col(total).cast("long")
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(done * 100 / F.greatest(total, F.lit(1))))).cast("int")


def epoch_seconds_text(seconds) -> Column:
    """`1970-01-01 00:00:00` and so on, in UTC whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(secs=_col(seconds).cast("decimal(18,6)"))).cast("string")


def epoch_millis_text(millis) -> Column:
    """The same of milliseconds, which are left out."""
    return epoch_seconds_text(F.floor(_col(millis) / 1000))


def integer_parameter(text, default: int) -> Column:
    return F.coalesce(_col(text).try_cast("int"), F.lit(default))


def decoded(text) -> Column:
    """A path parameter without its URL escapes."""
    return F.url_decode(_col(text))


def json_or_empty(text, kind) -> Column:
    """A JSON array as an array; what can't be read is empty."""
    return F.coalesce(F.from_json(_col(text), kind), F.from_json(F.lit("[]"), kind))


def entity_id(*parts) -> Column:
    """A row's id, the same in every run: it stands where the model has random ones."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(_col(p).cast("string"), F.lit("\x00")) for p in parts)), 256)


def spaced_camel(text) -> Column:
    """`placeOrder` -> `place Order`."""
    return F.trim(F.regexp_replace(_col(text), "([A-Z])", " $1"))


def grams(text: Column, size: Column) -> Column:
    """The different runs of size signs in text, none where it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: text.substr(i, size))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
