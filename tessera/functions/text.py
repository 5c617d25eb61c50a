"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?si)^```(?:json)?\s*(.*?)\s*```$"


def strip_fence(c: Column) -> Column:
    """The text inside a Markdown fence around everything; else the text."""
    text = F.trim(c)
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def strict_json(c: Column) -> Column:
    """Variant of a JSON text; null if it is malformed or repeats a key."""
    return F.try_parse_json(c)


def json_pointer(c: Column, pointer: str, kind: str = "string") -> Column:
    """The value at an RFC 6901 pointer in a JSON text; null if there is none."""
    path = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() and (part == "0" or part[0] != "0") else "['" + part.replace("'", "\\'") + "']"
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_within(p: Column, root: Column) -> Column:
    return (p == root) | F.startswith(p, F.concat(root, F.lit("/")))


def canonical_hash(*fields: Column) -> Column:
    """sha256 of compact JSON of the fields, which must come in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256)


def canonical_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def key_variants(c: Column) -> Column:
    """The key and its singular forms: without a last s, with y for a last ies."""
    k, n = canonical_key(c), F.length(canonical_key(c))
    forms = F.array(k, F.when(k.endswith("s") & (n > 1), F.left(k, n - 1)), F.when(k.endswith("ies") & (n > 3), F.concat(F.left(k, n - 3), F.lit("y"))))
    return F.array_distinct(F.array_compact(forms))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def is_digest(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_utc_timestamp(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


# Names and sizes of the frequency strata.
FREQUENCY_STRATA = (
    ("singleton_1", 1, 1),
    ("doubleton_2", 2, 2),
    ("low_recurrent_3_9", 3, 9),
    ("medium_recurrent_10_19", 10, 19),
    ("high_recurrent_20_99", 20, 99),
    ("dominant_100_plus", 100, None),
)


def evidence_tier(n: Column) -> Column:
    """singleton, doubleton or recurrent; null for sizes below 1."""
    return F.when(n >= 3, "recurrent").when(n == 2, "doubleton").when(n == 1, "singleton")


def frequency_stratum(n: Column) -> Column:
    """The stratum that holds the size; null for sizes below 1."""
    out = F.when(n < 1, F.lit(None).cast("string"))
    for name, least, most in FREQUENCY_STRATA:
        out = out.when((n >= least) & (n <= most) if most else n >= least, name)
    return out


def hash_side(c: Column) -> Column:
    """left or right by the parity of the first byte of the sha256."""
    return F.when(F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 2), 16, 10).cast("int") % 2 == 0, "left").otherwise("right")


def disposition(statuses: Column, incompatible: Column) -> Column:
    """One status for several: resolved, ambiguous, the one they share, or partial.

    incompatible: whether the readings exclude each other.
    """
    only = lambda *allowed: F.forall(statuses, lambda s: s.isin(*allowed))
    alone = F.size(F.array_distinct(statuses)) == 1
    return (
        F.when(incompatible, F.when(only("resolved", "specified", "ambiguous"), "ambiguous").otherwise("partial"))
        .when(only("resolved", "specified"), "resolved")
        .when(alone & only("unavailable", "abstained", "ambiguous"), F.get(statuses, F.lit(0)))
        .otherwise("partial")
    )


def is_rfc3339(c: Column) -> Column:
    """Whether a text is a date and time with offset."""
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
    return F.coalesce(c.rlike(form) & F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull() & ~F.regexp_like(c, F.lit(r"[+-](2[4-9]|[3-9][0-9]):[0-9]{2}$|[+-][0-9]{2}:[6-9][0-9]$")), F.lit(False))


def is_absolute_uri(c: Column) -> Column:
    """Whether a text has a scheme and then an authority or a path; http and https need an authority."""
    rest = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*:([^?#]*)", 1)
    web = F.lower(c).rlike("^https?:")
    authority = rest.rlike("^//[^/]+")
    some = F.when(rest.startswith("//"), authority | rest.rlike("^//[^/]*/")).otherwise(F.length(rest) > 0)
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~c.rlike(r"\s") & F.when(web, authority).otherwise(some), F.lit(False))


def pointers_overlap(a: Column, b: Column) -> Column:
    return pointer_within(a, b) | pointer_within(b, a)


def _members(union: Column) -> Column:
    return F.filter(F.transform(F.split(union, r"\|"), lambda m: F.trim(m)), lambda m: m != "")


def compatible_types(source: Column, expected: Column) -> Column:
    """Whether two unions of types, written with |, have a member in common."""
    return F.coalesce(F.arrays_overlap(_members(source), _members(expected)), F.lit(False))


def compatible_cardinalities(source: Column, expected: Column, expected_type: Column) -> Column:
    """Whether what gives ``source`` values may feed what takes ``expected`` ones; collections take any number."""
    known = ("one", "optional", "one_or_more", "zero_or_more")
    whole = F.exists(_members(F.coalesce(expected_type, F.lit(""))), lambda m: m.endswith("Set") | m.isin("Table", "GroupedValues", "ComparedValueSet"))
    fits = F.when(expected.isin("optional", "zero_or_more"), True).when(expected == "one", (source == "one") | whole).otherwise(source.isin("one", "one_or_more") | whole)
    return F.coalesce(source.isin(*known) & expected.isin(*known) & fits, F.lit(False))


def shown(c: Column) -> Column:
    """A fraction with three decimals; N/A for null."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.3f", c.cast("double")))


def ordered_hash(values: Column) -> Column:
    """sha256 of the compact JSON of a list of texts, in its order."""
    return F.sha2(F.to_json(values).cast("binary"), 256)


def ordered_lines_hash(rows: Column) -> Column:
    """sha256 of lines ``digest  path`` of structs (path, digest), in order of the path's bytes."""
    return F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(r["digest"], F.lit("  "), r["path"], F.lit("\n"))), "").cast("binary"), 256)
