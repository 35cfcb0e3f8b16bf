"""Placeholders in texts, XML text, and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of placeholders, and of those with a name.
PLACEHOLDER = r"\{\{([^{}]*)\}\}"
FILLED = r"\{\{[^{}]*[^{}\s][^{}]*\}\}"


def placeholders(text: Column) -> Column:
    """array<string> of the names in {{ name }}, trimmed, in order, repeats included."""
    names = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), lambda x: F.trim(x))
    return F.filter(names, lambda x: x != "")


def malformed(text: Column) -> Column:
    """Whether double braces are left once all placeholders with a name are taken out."""
    rest = F.regexp_replace(text, FILLED, "")
    return rest.contains("{{") | rest.contains("}}")


def filled(text: Column, values: dict[str, Column]) -> Column:
    """text with each placeholder of values replaced; a value is never searched for placeholders again."""
    parts, gaps = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.split(text, PLACEHOLDER, -1)
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    value = lambda m: F.coalesce(F.try_element_at(known, F.trim(F.substring(m, F.lit(3), F.length(m) - 4))), m)
    return F.array_join(F.zip_with(gaps, parts, lambda g, m: F.concat(g, F.coalesce(value(m), F.lit("")))), "")


def xml_encoded(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def xml_decoded(c: Column) -> Column:
    """XML text with its named and numbered characters, each resolved once; numbers that stand for no character stay."""
    entity = "&(?:lt|gt|quot|apos|amp|#x[0-9A-Fa-f]{1,8}|#[0-9]{1,9});"
    named = F.create_map(*[F.lit(x) for pair in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")) for x in pair])

    def one(e: Column) -> Column:
        digits = F.regexp_extract(e, "([0-9A-Fa-f]+);$", 1)
        code = F.when(e.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(e.startswith("&#"), F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(e)).otherwise(F.element_at(named, e))

    parts, gaps = F.regexp_extract_all(c, F.lit(entity), F.lit(0)), F.split(c, entity, -1)
    whole = F.array_join(F.zip_with(gaps, parts, lambda g, e: F.concat(g, F.coalesce(F.when(e.isNotNull(), one(e)), F.lit("")))), "")
    return F.when(c.contains("&"), whole).otherwise(c)


def quantity(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def page_name(prefix: Column, page: Column, pages: Column) -> Column:
    """prefix-page-007.pdf, with as many digits as the last page needs, three at least."""
    width = F.greatest(F.lit(3), F.length(pages.cast("string")))
    return F.concat(prefix, F.lit("-page-"), F.lpad(page.cast("string"), width, F.lit("0")), F.lit(".pdf"))
