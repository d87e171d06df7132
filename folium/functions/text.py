"""Scalar functions as Column expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, as the strip function understands it.
_EDGES = r"(?U)^\s+|\s+$"
BLANK = ""


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, BLANK)


def token_count(text: Column) -> Column:
    """Runs of other than white space; null and empty text have none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), F.lit(0))


def to_int(value: Column, default: int | None = None) -> Column:
    """A whole number, or the default where there is none."""
    found = F.trim(value.cast("string")).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))




def parse_physical_index(value: Column) -> Column:
    """5 from "<physical_index_5>", "physical_index_5" or " 5 "; null from anything else."""
    tagged = F.nullif(F.regexp_extract(value, r"physical_index_(\d+)", 1), F.lit(BLANK)).try_cast("int")
    return F.coalesce(tagged, to_int(value))


def page_to_int(value: Column) -> Column:
    return to_int(value)


def strip_fence(reply: Column) -> Column:
    """What stands between the first ```json and the last ``` behind it; else the stripped text; "" for null."""
    fenced = F.regexp_extract(reply, r"(?s)^.*?```json(.*)```", 1)
    return F.when(reply.isNull(), F.lit(BLANK)).when(reply.rlike(r"(?s)```json.*```"), strip(fenced)).otherwise(strip(reply))


def extract_json(reply: Column, compat: bool = False) -> Column:
    """A reply as VARIANT.  First None becomes null (within words too if compat) and white space is collapsed; if that doesn't
    parse, commas before closing brackets go; if that doesn't either, it is an empty object."""
    plain = strip_fence(reply)
    none = "None" if compat else r"\bNone\b"
    first = F.trim(F.regexp_replace(F.regexp_replace(plain, none, "null"), r"\s+", " "))
    second = F.regexp_replace(F.regexp_replace(plain, r",\s*]", "]"), r",\s*\}", "}")
    both = F.regexp_replace(F.regexp_replace(first, r",\s*]", "]"), r",\s*\}", "}")
    return F.coalesce(F.try_parse_json(F.nullif(first, F.lit(BLANK))), F.try_parse_json(second), F.try_parse_json(both), F.parse_json(F.lit("{}")))


def json_field(parsed: Column, field: str, default: str) -> Column:
    return F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string"), F.lit(default))


def string_array(reply: Column) -> Column:
    """A JSON array of strings, or no strings."""
    return F.coalesce(F.from_json(strip_fence(reply), "array<string>"), F.array().cast("array<string>"))


def dot_leaders(text: Column) -> Column:
    """Five or more dots, or dots with spaces, become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def heading_title(line: Column) -> Column:
    """The title of a Markdown heading on a stripped line, or null."""
    return F.nullif(strip(F.regexp_extract(strip(line), r"^#{1,6}\s+(.+)$", 1)), F.lit(BLANK))


def heading_level(line: Column) -> Column:
    """The number of # at the beginning of the line as it is; 0 for an indented heading."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})", 1))


def parent_code(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"^(.+)\.[^.]*$", 1), F.lit(BLANK))


def tagged(page_no: Column, text: Column, trailing: int = 2) -> Column:
    tag = F.concat(F.lit("<physical_index_"), page_no.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag, F.lit("\n" * trailing))


def doc_key(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(pdf|md|markdown)$", BLANK)


def job_id() -> Column:
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit(BLANK)), F.lit(10))


def client_of(forwarded: Column, remote: Column) -> Column:
    """The first hop of a forwarded-for header, or the remote address, fit for a key."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.translate(F.coalesce(F.nullif(first, F.lit(BLANK)), remote), ".:", "__")


def outline_line(depth: Column, title: Column, start: Column, end: Column) -> Column:
    pages = F.when(start.isNotNull(), F.concat(F.lit(" (pages "), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("null")), F.lit(")"))).otherwise(F.lit(BLANK))
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.coalesce(title, F.lit("Untitled")), pages, F.lit("\n"))


def continued(partial: Column) -> Column:
    """A cut reply up to one character behind its last closing brace."""
    return F.regexp_extract(partial, r"(?s)^(.*\}.?)", 1)


def squeezed(text: Column) -> Column:
    """Lower case without white space: how titles are compared with pages."""
    return F.regexp_replace(F.lower(text), r"\s+", BLANK)


def shortened(text: Column, n: int = 200) -> Column:
    return F.left(text, F.lit(n))


def log_class(line: Column) -> Column:
    lower = F.lower(line)
    return F.when(lower.contains("error"), "error").when(lower.contains("warning"), "warning").when(lower.contains("done"), "done").otherwise("info")


def node_id(number: Column) -> Column:
    return F.format_string("%04d", number)
