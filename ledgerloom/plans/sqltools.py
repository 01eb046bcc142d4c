"""Fragments of DuckDB SQL shared by the checks."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {quote(SPACE + '+')}, ' ', 'g'))"


def fold(x: str) -> str:
    dashes = "".join(f"\\x{{{c:x}}}" for c in range(0x2010, 0x2016))
    return f"replace(replace(regexp_replace(regexp_replace({x}, '[{dashes}]', '-', 'g'), '[\\x{{201c}}\\x{{201d}}]', '\"', 'g'), chr(8216), ''''), chr(8217), '''')"


def entities(x: str) -> str:
    for name, char in (
        ("&nbsp;", "chr(160)"),
        ("&quot;", "'\"'"),
        ("&mdash;", "chr(8212)"),
        ("&#39;", "''''"),
        ("&lt;", "'<'"),
        ("&gt;", "'>'"),
        ("&amp;", "'&'")
    ):
        x = f"replace({x}, '{name}', {char})"
    return x


def substitute(x: str, pattern: str, replacement: str) -> str:
    """Replace every match; ``replacement`` is SQL over {g1} and {g2}, the match's first two groups."""
    p = quote(pattern)
    put = replacement.replace("{g1}", "a[i]").replace("{g2}", "b[i]")
    return (
        f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN {put} ELSE '' END), '')"
        f" FROM (SELECT string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}, 1) AS a, regexp_extract_all(t, {p}, 2) AS b FROM (SELECT {x} AS t)))"
    )


def words(x: str) -> str:
    return f"CASE WHEN {collapse(x)} = '' THEN [] ELSE string_split(lower({collapse(x)}), ' ') END"
