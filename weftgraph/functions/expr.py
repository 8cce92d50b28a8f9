"""Column expressions of the code graph. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of edges and the ranks of types and relations.
CONTAINMENT = ("HAS_METHOD", "HAS_PROPERTY", "HAS_FIELD", "CONTAINS")
FAMILY = ("IMPLEMENTS_MEMBER", "OVERRIDES_MEMBER")
SEMANTIC = ("CALLS", "MOCK_CALLS", "REFERENCES", "IMPLEMENTS", "INHERITS", "EXTENDS", "IMPORTS", "IMPLEMENTS_MEMBER", "OVERRIDES_MEMBER")
RELATIONS = ("CALLS", "MOCK_CALLS", "REFERENCES", "IMPLEMENTS", "INHERITS", "EXTENDS", "IMPORTS", "USES")
TYPE_RANK = {"CLASS": 0, "INTERFACE": 1, "METHOD": 2, "PROPERTY": 3}
RELATION_RANK = {"IMPLEMENTS": 0, "INHERITS": 1, "EXTENDS": 1, "CALLS": 2, "REFERENCES": 3, "USES": 3, "IMPORTS": 4}
TEST_PREFIXES = ("test", "should", "can", "given", "when", "then")
TEST_SUFFIXES = ("test", "tests")
TEST_MARKS = ("[test", "[fact", "[theory")
LANGUAGES = {"cs": "C#", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mts": "TypeScript", "cts": "TypeScript", "mjs": "JavaScript", "cjs": "JavaScript", "vue": "Vue", "py": "Python", "pyw": "Python"}
COMPLEXITY = {"Class": 5, "Interface": 3, "Method": 2, "Property": 1}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranked(value: Column, ranks: dict[str, int], rest: int) -> Column:
    out = F.lit(rest)
    for name, rank in ranks.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def fold(c: Column | str) -> Column:
    """The key of comparisons and orders that ignore case: upper case, so that `_` follows letters."""
    return F.upper(col(c))


def is_usage(kind: Column | str = "type") -> Column:
    return col(kind).isNull() | ~fold(kind).isin(*CONTAINMENT, *FAMILY)


def is_family(kind: Column | str = "type") -> Column:
    return F.coalesce(fold(kind).isin(*FAMILY), F.lit(False))


def is_semantic(kind: Column | str = "type") -> Column:
    return F.coalesce(fold(kind).isin(*SEMANTIC), F.lit(False))


def shown(kind: Column | str = "type") -> Column:
    return F.coalesce(col(kind), F.lit("USES"))


def type_rank(kind: Column | str = "type") -> Column:
    return ranked(fold(kind), TYPE_RANK, 4)


def relation_rank(kind: Column | str = "type") -> Column:
    return ranked(fold(shown(kind)), RELATION_RANK, 5)


def path_key(path: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.translate(col(path), "\\", "/"), "/+$", ""))


def display_path(path: Column | str, root: str) -> Column:
    """Relative to the root where it lies below, with forward slashes."""
    p, top = F.translate(col(path), "\\", "/"), root.rstrip("/") + "/"
    return F.when(p.startswith(top), F.substring(p, len(top) + 1, 1 << 30)).otherwise(p)


def is_test_path(path: Column | str = "file_path") -> Column:
    return F.coalesce(fold(path).contains("TEST") | fold(path).contains("SPEC"), F.lit(False))


def is_test_method(name: Column | str = "name", signature: Column | str = "signature", flag: Column | str = "is_test") -> Column:
    low = F.lower(F.coalesce(col(name), F.lit("")))
    out = F.lower(F.coalesce(col(flag), F.lit(""))) == "true"
    for p in TEST_PREFIXES:
        out = out | low.startswith(p)
    for s in TEST_SUFFIXES:
        out = out | low.endswith(s)
    out = out | low.contains("_should_")
    for m in TEST_MARKS:
        out = out | F.coalesce(F.lower(col(signature)).contains(m), F.lit(False))
    return (low != "") & out


def legacy_identifier(identifier: Column | str = "identifier", id_: Column | str = "id") -> Column:
    """The identifier or, where it is empty, what follows the second colon of the id."""
    rest = F.regexp_extract(col(id_), r"^[^:]*:[^:]*:(.*)$", 1)
    return F.when(F.coalesce(col(identifier), F.lit("")) != "", col(identifier)).when(col(id_).rlike("^[^:]*:[^:]*:"), rest).otherwise(col(id_))


def containing_type(identifier: Column | str = "identifier") -> Column:
    """The type that a member's identifier names: after the last #, before (, the segment before the last."""
    text = F.regexp_extract(col(identifier), r"([^#]*)$", 1)
    head = F.substring_index(text, "(", 1)
    owner = F.regexp_extract(head, r"^(.*)\.[^.]*$", 1)
    return F.substring_index(owner, ".", -1)


def compact_signature(signature: Column | str = "signature", most: int = 160) -> Column:
    one = F.regexp_replace(F.trim(col(signature)), r"\s+", " ")
    return F.when(F.char_length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def language_of(path: Column | str = "file_path") -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1))
    out = F.lit("")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def complexity(kind: Column | str = "type", start: Column | str = "start_line", end: Column | str = "end_line") -> Column:
    lines = col(end) - col(start) + 1
    return (ranked(col(kind), COMPLEXITY, 1) + F.floor(lines / 10)).cast("long")


def normal_span(value: Column | str, base: int, inclusive: bool = False) -> Column:
    return F.greatest(F.lit(0), col(value) - base) + int(inclusive)
