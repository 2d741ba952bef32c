"""String functions whose usual Spark spelling differs or is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varchar(c: Column, n: int) -> Column:
    """Explicit cast to varchar(n): cuts. (Spark's own cast does not.)"""
    return F.substring(c, 1, n)


def bpchar(c: Column, n: int) -> Column:
    """Cast to char(n): cut, then padded with blanks."""
    return F.rpad(F.substring(c, 1, n), n, " ")


def concat(*cols: Column) -> Column:
    """Concatenation that skips nulls (``||`` is null-strict: use F.concat)."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def left(c: Column, n: int) -> Column:
    """First n characters; a negative n drops the last -n."""
    return F.substring(c, 1, n) if n >= 0 else F.substring(c, F.lit(1), F.greatest(F.length(c) + n, F.lit(0)))


def right(c: Column, n: int) -> Column:
    """Last n characters; a negative n drops the first -n."""
    if n >= 0:
        return F.when(F.length(c) <= n, c).otherwise(F.substring(c, -n, n) if n else F.lit(""))
    return F.substring(c, F.lit(1 - n), F.length(c))


def overlay(c: Column, new: Column, start: int, length: int | None = None) -> Column:
    return F.overlay(c, new, F.lit(start), F.lit(-1 if length is None else length))


def quote_ident(c: Column) -> Column:
    """Double quotes where the name is not a plain lower-case identifier."""
    plain = c.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(c: Column) -> Column:
    """SQL string literal; backslashes use the escape form."""
    body = F.replace(F.replace(c, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    prefix = F.when(F.contains(c, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'"))
    return F.concat(prefix, body, F.lit("'"))


def quote_nullable(c: Column) -> Column:
    return F.coalesce(quote_literal(c), F.lit("NULL"))


def parse_ident(c: Column) -> Column:
    """Parts of a qualified name: unquoted ones in lower case, quotes taken off."""
    parts = F.regexp_extract_all(c, F.lit(r'"(?:[^"]|"")*"|[^."\s]+'), F.lit(0))
    inner = lambda p: F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), inner(p)).otherwise(F.lower(p)))


def format_sql(template: str, *args: Column) -> Column:
    """format(): %s text, %I identifier, %L literal, %% percent; ``%2$s`` picks an argument by position."""
    import re

    out, last, nxt = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        out.append(F.lit(template[last : m.start()]))
        last = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        at = int(m[1]) - 1 if m[1] else nxt
        nxt = at + 1
        a = args[at].cast("string")
        out.append({"s": F.coalesce(a, F.lit("")), "I": quote_ident(a), "L": quote_nullable(a)}[m[2]])
    return F.concat(*out, F.lit(template[last:]))


def similar_to(c: Column, pattern: str) -> Column:
    """SQL regular expressions: % and _ are wildcards, | * + ? {} () [] as usual, the whole string must match."""
    out, in_class = [], False
    for ch in pattern:
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        if in_class or ch in "|*+?{}()[],-]" or ch.isalnum() or ch == " ":
            out.append(ch)
        else:
            out.append({"%": ".*", "_": "."}.get(ch, "\\" + ch))
    return c.rlike("(?s)^(?:" + "".join(out) + ")$")


def regexp_replace(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """First match only unless ``g``; ``i`` ignores case. Groups are written $1."""
    p = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(c, p, replacement)
    shifted = __import__("re").sub(r"\$(\d)", lambda m: "$" + str(int(m[1]) + 1), replacement)
    flag = "(?is)" if "i" in flags else "(?s)"
    return F.regexp_replace(c, f"{flag}^(.*?){pattern}", "$1" + shifted)


def regexp_match(c: Column, pattern: str, groups: int = 1) -> Column:
    """Array of the groups of the first match, null without a match."""
    found = F.array(*[F.regexp_extract(c, pattern, g) for g in range(1, groups + 1)])
    return F.when(c.rlike(pattern), found)


def regexp_matches(c: Column, pattern: str, group: int = 1) -> Column:
    """One group of every match, in order (explode it for rows)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def encode(c: Column, form: str) -> Column:
    """bytea to text: hex, base64 or escape (printable ASCII as is, backslash doubled, others in octal)."""
    if form == "hex":
        return F.lower(F.hex(c))
    if form == "base64":
        return F.base64(c)
    codes = F.transform(F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    octal = lambda b: F.concat(F.lit("\\"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))
    one = lambda b: F.when(b == 92, F.lit("\\\\")).when(b.between(32, 126), F.char(b)).otherwise(octal(b))
    return F.array_join(F.transform(codes, one), "")


def get_bit(bits: Column, n: int) -> Column:
    """Bit n (from 0, the leftmost) of a bit string."""
    return F.substring(bits, n + 1, 1).cast("int")


def set_bit(bits: Column, n: int, value: int) -> Column:
    return F.overlay(bits, F.lit(str(value)), F.lit(n + 1), F.lit(1))


def bits_op(a: Column, b: Column, op: str) -> Column:
    """and, or, xor of two bit strings of one length."""
    pick = {
        "and": lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"),
        "or": lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"),
        "xor": lambda x, y: F.when(x != y, "1").otherwise("0"),
    }[op]
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: pick(x, y)), "")


def bits_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bits_shift(a: Column, n: int) -> Column:
    """Shift left (n > 0) or right, keeping the length."""
    zeros = "0" * abs(n)
    if n >= 0:
        return F.substring(F.concat(F.substring(a, F.lit(n + 1), F.length(a)), F.lit(zeros)), F.lit(1), F.length(a))
    return F.substring(F.concat(F.lit(zeros), a), F.lit(1), F.length(a))
