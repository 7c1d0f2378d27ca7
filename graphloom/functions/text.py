"""Identifiers, terms, paths and rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a task.
STOP_WORDS = ("a an and are as at be by create for from in into is it of on or our that the this to tool we with").split()


def normalized(text: Column) -> Column:
    """Lower-case runs of letters and digits joined by blanks; camelCase is split."""
    parted = F.regexp_replace(text, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")
    return F.array_join(F.regexp_extract_all(F.lower(parted), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def terms(text: Column, stop=STOP_WORDS) -> Column:
    """Sorted distinct terms of two characters or more that are no stop words."""
    found = F.split(normalized(text), " ")
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop))))


def term_matches(token: Column, term: Column) -> Column:
    """Equal, or alike in five leading characters or more."""
    return (token == term) | ((F.length(token) >= 5) & (F.length(term) >= 5) & (F.left(token, F.lit(5)) == F.left(term, F.lit(5))))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")


def half_up(x: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity, unlike round()."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def stable_id(file: Column, line: Column, col: Column, name: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), col.cast("string"), name)


def parse_stable_id(id_: Column) -> Column:
    """(file, line, col, name); external names have null places."""
    pattern = r"^(.*):(\d+):(\d+):([^:]*)$"
    part = lambda k: F.regexp_extract(id_, pattern, k)
    own = id_.rlike(pattern)
    return F.struct(
        F.when(own, part(1)).alias("file"),
        F.when(own, part(2).cast("int")).alias("line"),
        F.when(own, part(3).cast("int")).alias("col"),
        F.when(own, part(4)).when(id_.startswith("external:"), F.substring(id_, 10, 2**30)).otherwise(id_).alias("name"),
    )


def slug(text: Column, default: str = "project") -> Column:
    s = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit("and")), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a path glob: ** crosses folders, * and ? do not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
            i += 1
    return f"^{''.join(out)}$"


def matches_glob(path: Column, *globs: str) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_pattern(g))
    return hit


def fence_for(text: Column) -> Column:
    """Backticks longer than any run of them inside, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))


def json_string(text: Column) -> Column:
    """A JSON string literal, which is also a Cypher one."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def title_case(text: Column) -> Column:
    """Words between dashes, underscores or blanks, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(text, r"[-_\s]+", " ")))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def ancestors(path: Column) -> Column:
    """Folders above a path, the root ("") first."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))


def safe_path(path: Column) -> Column:
    """Relative, without `..`, NUL or backslash."""
    bad = path.startswith("/") | path.contains("\\") | path.contains("\0") | F.array_contains(F.split(path, "/"), "..") | path.rlike("^[A-Za-z]:")
    return path.isNotNull() & (path != "") & ~bad


def is_test_path(path: Column) -> Column:
    """A test or spec file by its name or folder."""
    return path.rlike(r"(^|/)(tests?|__tests__|specs?)/|\.(test|spec)\.[cm]?[jt]sx?$")


def is_declaration_path(path: Column) -> Column:
    return path.rlike(r"\.d\.[cm]?ts$")


def is_source_path(path: Column) -> Column:
    return path.rlike(r"\.[cm]?[jt]sx?$")


def excluded(path: Column, *fragments: str) -> Column:
    hit = F.lit(False)
    for f in fragments:
        hit = hit | path.contains(f)
    return hit


def xpath_literal(text: str) -> str:
    """A string literal of XPath, which has no escapes: parts with the other quote are concatenated."""
    if "'" not in text:
        return f"'{text}'"
    if '"' not in text:
        return f'"{text}"'
    return "concat(" + ", \"'\", ".join(f"'{p}'" for p in text.split("'")) + ")"


def retry_after_ms(header: Column, remaining: Column, reset_s: Column, now_s: Column) -> Column:
    """Milliseconds to wait: seconds or a date in `Retry-After`, else until a spent rate limit starts anew and a second more."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(header, r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss")).cast("double")
    rate = F.when((remaining == "0") & (reset_s > 0), F.greatest(F.lit(1000.0), (reset_s - now_s) * 1000 + 1000))
    return F.coalesce(F.when(seconds >= 0, seconds * 1000), F.when(date.isNotNull(), F.greatest(F.lit(0.0), (date - now_s) * 1000)), rate)
