"""Column functions over plan-node text, plan text and SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_partition_count(text: Column) -> Column:
    """The number between the last ``,`` and the last ``)`` of a node's text; 0 when it is not a number.

    Where no comma precedes the last ``)``, everything after the first character is tried.
    """
    # Plain text functions: every node of every plan comes here, and most have no bracket.
    after = F.substring_index(text, ")", -1)
    before = F.left(text, F.length(text) - F.length(after) - 1)
    number = F.when(before.contains(","), F.substring_index(before, ",", -1)).otherwise(F.substr(before, F.lit(2)))
    return F.when(text.contains(")"), F.coalesce(number.try_cast("bigint"), F.lit(0))).when(text.isNotNull(), F.lit(0))


def scanned_table(text: Column) -> Column:
    """STRUCT<db, table> named by the third word of a scan node's text; NULL when there is none."""
    name = F.regexp_extract(text, r"^\S+ \S+ ([^\[ ]+)\[", 1)
    parts = F.split(name, r"\.")
    return F.when(
        F.size(parts) >= 2,
        F.struct(F.element_at(parts, -2).alias("db"), F.element_at(parts, -1).alias("table")),
    )


def _keys(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda k: F.trim(F.split(k, "#")[0]))


def join_parts(text: Column) -> Column:
    """STRUCT<name, left_keys, right_keys, join_type> of an equi-join node's text.

    Text of any other form gives empty strings and empty lists.
    """
    pattern = r"(?s)^([^\[]*)\[([^\]]*)\][^\[]*\[([^\]]*)\][^,]*,([^,]*)"

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    matched = text.rlike(pattern)
    none = F.array().cast("array<string>")
    return F.struct(
        F.trim(part(1)).alias("name"),
        F.when(matched, _keys(part(2))).otherwise(none).alias("left_keys"),
        F.when(matched, _keys(part(3))).otherwise(none).alias("right_keys"),
        F.trim(part(4)).alias("join_type"),
    )


def normalize_ids(plan: Column) -> Column:
    """Rewrite expression ids ``#12`` / ``#12L`` to ``#1, #2, ...`` by first appearance in the text."""

    def renumber(found: Column) -> Column:
        # The text between tokens has one piece more than there are tokens.
        pieces = F.zip_with(
            found["between"],
            found["tokens"],
            lambda piece, token: F.when(token.isNull(), piece).otherwise(
                F.concat(piece, F.lit("#"), F.array_position(found["firsts"], token).cast("string"))
            ),
        )
        return F.array_join(pieces, "")

    tokens = F.regexp_extract_all(plan, F.lit(r"#\d+L?"), F.lit(0))
    found = F.struct(
        F.split(plan, r"#\d+L?", -1).alias("between"),
        tokens.alias("tokens"),
        F.array_distinct(tokens).alias("firsts"),
    )
    # Bound once as a lambda variable, so the expressions are not run again for every token.
    return F.element_at(F.transform(F.array(found), renumber), 1)


# What a reader of SQL text meets, one token at a time. Every character belongs to a token.
_GAP = r"(?:\s|--[^\n]*|/\*.*?\*/)++"
_STRING = r"""(?:r'[^']*+'|r"[^"]*+"|'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+")"""
_QUOTED_NAME = r"`(?:[^`]|``)*+`"
# A number after a name and a point is a part of the name.
_NAME = r"[\p{L}_][\p{L}\p{N}_]*+(?:\.\p{N}[\p{L}\p{N}_]*+)*+"
_FRACTION = r"(?:(?:\d++\.\d*+|\.\d++)(?:e[+-]?\d++)?+(?:bd|[df])?+|\d++e[+-]?\d++(?:bd|[df])?+|\d++(?:bd|[df]))(?![\p{L}\p{N}_.])"
_WHOLE = r"\d++(?![\p{L}\p{N}_.])"
_OTHER_NUMBER = r"[\p{N}.][\p{L}\p{N}_.]*+"
_SQL_TOKEN = f"(?is){_GAP}|{_STRING}|{_QUOTED_NAME}|{_NAME}|{_FRACTION}|{_WHOLE}|{_OTHER_NUMBER}|."


def without_literals(sql: Column) -> Column:
    """Blank string, fractional and integer literals, drop comments and fold white space.

    Texts that differ only in such constants become equal. The text is read token by token, so that what looks like a literal
    inside a string, a quoted name or a comment is not taken for one. Strings in either quotes, with doubled quotes or a backslash
    before one, become ``''``; fractions, also with an exponent or one of the suffixes D, F and BD, ``0.0``; whole numbers ``0``. Names in
    back quotes stay as they are, and so do numbers with another suffix (``123L``).
    """

    def blank(token: Column) -> Column:
        return (
            F.when(token.rlike(f"(?is)^{_STRING}$"), F.lit("''"))
            .when(token.rlike(f"(?is)^{_GAP}$"), F.lit(" "))
            .when(token.rlike(f"(?i)^{_FRACTION}$"), F.lit("0.0"))
            .when(token.rlike(f"^{_WHOLE}$"), F.lit("0"))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(sql, F.lit(_SQL_TOKEN), F.lit(0))
    return F.trim(F.array_join(F.transform(tokens, blank), ""))


def fingerprint(sql: Column) -> Column:
    """Hash of the text without its literals."""
    return F.md5(without_literals(sql))
