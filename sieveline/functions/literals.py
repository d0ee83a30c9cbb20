"""Lists written as Python literals, read by built-in expressions: a fold over tokens that knows quotes and escapes.

Items are strings in single or double quotes (with escapes, and next to each other as one), whole and decimal numbers,
None, True and False; a comma may follow the last item. Other text isn't such a list: names, other literals as items,
numbers with exponents, in other bases or with more than 15 digits, strings that hold a line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a quoted string, a comma, or a run of other characters. An unclosed quote is a token of its own.
TOKEN = r"""[uU]?'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|[uU]?"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|,|[^\s,'"\\]+|\\(?!\n)|['"]"""
STRING = r"""^[uU]?['"][\s\S]*['"]$"""
PLAIN = r"^(?:None|True|False|-?(?:0|[1-9][0-9]*)|-?(?=[0-9.]{3,16}$)(?!0\.0000[0-9]*[1-9])(?:0|[1-9][0-9]*)\.[0-9]+)$"
#: Parts of a string's text: an escape, or characters without one.
PART = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+"
#: Escapes of one character and what they stand for.
ESCAPES = {"\\\\": "\\", "\\'": "'", '\\"': '"', "\\n": "\n", "\\t": "\t", "\\r": "\r", "\\a": "\a", "\\b": "\b", "\\f": "\f", "\\v": "\v", "\\\n": ""}
#: What follows a backslash and makes text that isn't read here.
UNREAD = r"""(?<!\\)(?:\\\\)*\\(?:N|x(?![0-9A-Fa-f]{2})|u(?![0-9A-Fa-f]{4})|u[dD][89A-Fa-f]|U(?!000[0-9A-Fa-f]{5}|0010[0-9A-Fa-f]{4}))"""


def _part(p: Column) -> Column:
    wide = lambda digits, charset: F.decode(F.unhex(digits), charset)
    out = F.when(p.rlike(r"^\\[xu]"), wide(F.lpad(F.substr(p, F.lit(3)), 4, "0"), "UTF-16BE")).when(p.rlike(r"^\\U"), wide(F.substr(p, F.lit(3)), "UTF-32"))
    out = out.when(p.rlike(r"^\\[0-7]"), wide(F.lpad(F.conv(F.substr(p, F.lit(2)), 8, 16), 4, "0"), "UTF-16BE"))
    for escape, stands_for in ESCAPES.items():
        out = out.when(p == escape, stands_for)
    return out.otherwise(p)


def _text(token: Column) -> Column:
    """A quoted string's text."""
    inner = F.regexp_replace(token, r"""^[uU]?['"]|['"]$""", "")
    return F.when(inner.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(PART), F.lit(0)), _part), "")).otherwise(inner)


def _number(token: Column) -> Column:
    """A number's text as Python writes it."""
    short = F.regexp_replace(F.regexp_replace(token, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
    return F.when(token == "-0", "0").when(token.contains("."), short).otherwise(token)


def literal_items(c: Column) -> Column:
    """The items of a list literal as texts; null where the text isn't one (as it is read here) or is null."""
    body = F.regexp_extract(c, r"^[ \t]*\[([\s\S]*)\]\s*$", 1)
    tokens = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    # a fold with state (whether an item may come, whether a string goes on, items); null once anything is wrong
    start = F.struct(F.lit(True).alias("open"), F.lit(False).alias("string"), F.array().cast("array<string>").alias("items"))

    def step(s: Column, t: Column) -> Column:
        is_string, plain = t.rlike(STRING) & (F.char_length(t) > 1), t.rlike(PLAIN)
        to = lambda open_, string, items: F.struct(F.lit(open_).alias("open"), F.lit(string).alias("string"), items.alias("items"))
        last = F.element_at(s["items"], -1)
        longer = F.concat(F.slice(s["items"], 1, F.size(s["items"]) - 1), F.array(F.concat(last, _text(t))))
        return (
            F.when(s.isNull(), s)
            .when((t == ",") & ~s["open"], to(True, False, s["items"]))
            .when(is_string & s["open"], to(False, True, F.array_append(s["items"], _text(t))))
            .when(is_string & s["string"], to(False, True, longer))
            .when(plain & s["open"], to(False, False, F.array_append(s["items"], _number(t))))
        )

    read = F.aggregate(tokens, start, step, lambda s: s["items"])
    return F.when(c.rlike(r"^[ \t]*\[[\s\S]*\]\s*$") & ~c.contains("\0") & ~body.rlike(UNREAD), read)
