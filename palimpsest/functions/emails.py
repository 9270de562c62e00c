"""E-mail functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# Patterns.
EMAIL = r"(?<![A-Za-z0-9._%+\-/])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24})(?![A-Za-z0-9])"
AT = r"\s*[\[\(\{]\s*(?:at|@|собака|sobaka)\s*[\]\)\}]\s*|\s+(?:at|@|собака|sobaka)\s+"
DOT = r"\s*[\[\(\{]\s*(?:dot|\.|точка|tochka)\s*[\]\)\}]\s*|\s+(?:dot|точка|tochka)\s+"


def found(text: Column | str) -> Column:
    """Addresses in the order in which they stand."""
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1))


def canonical(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"[.,;:]+$", "")


def plausible(address: Column) -> Column:
    """Whether a lower-case address isn't an asset's name, an escape or the residue of prose; its domain is never a reason."""
    ends = "|".join(x.replace(".", r"\.") for x in V.EMAIL_ASSETS)
    return ~(address.rlike(rf"(?:{ends})$") | address.rlike(r"u003e|u003c|\\x") | address.rlike(r"^@|@$|@www\."))


def plain(text: Column | str) -> Column:
    """text with spelled-out 'at' and 'dot' replaced."""
    return F.regexp_replace(F.regexp_replace(text, f"(?iuU){AT}", "@"), f"(?iuU){DOT}", ".")


def is_prose(address: Column) -> Column:
    """Whether the local part is a word that stands before 'at' in prose."""
    return F.substring_index(address, "@", 1).isin(V.PROSE_WORDS)


def decode_cfemail(token: Column) -> Column:
    """The address in a protected attribute (hex, the first byte is the key); null if it isn't one."""
    key = F.conv(F.substring(token, 1, 2), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(3), F.length(token) - 1, F.lit(2)), lambda i: F.char(F.conv(F.substring(token, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)))
    text = F.when(token.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(codes, ""))
    return F.when(text.contains("@"), text)


def spelled(text: Column) -> Column:
    """Whether a text holds a word or sign that stands for 'at' where plain() would read it."""
    return text.rlike(r"(?iuU)[\[({]\s*@\s*[\])}]|\s@\s|\b(?:at|собака|sobaka)\b")


def contacts(text: Column | str) -> Column:
    """array<struct<value, raw, pass>> of a normalised text: plain addresses first, then spelled-out ones, each value once."""
    text = F.col(text) if isinstance(text, str) else text

    def of(found_: Column, step: int) -> Column:
        made = F.transform(found_, lambda r: F.struct(canonical(r).alias("value"), r.alias("raw"), F.lit(step).alias("pass")))
        return F.filter(made, lambda c: plausible(c["value"]) & (F.lit(step == 1) | ~is_prose(c["value"])))

    none = F.array().cast("array<struct<value:string,raw:string,pass:int>>")
    both = F.concat(of(found(text), 1), F.when(spelled(text), of(found(plain(text)), 2)).otherwise(none))
    # A fold reads its array once; an array named inside a lambda would be made again for each element.
    return F.aggregate(both, none, lambda kept, c: F.when(F.exists(kept, lambda k: k["value"] == c["value"]), kept).otherwise(F.concat(kept, F.array(c))))
