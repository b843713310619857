"""Column expressions with the text and JSON rules of the data model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: All that Python's str.strip() takes for white space.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_HOSTS_RAW = "raw.githubusercontent.com"
#: Stands behind a text that is parsed, to show where it ends.
_END = "end-of-line-5b0f1c92"
OBJECT = "map<string, variant>"


def configure(spark: SparkSession) -> SparkSession:
    """JSON objects may repeat a key (the last counts)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def strip(c: Column) -> Column:
    """Without the Unicode white space at both ends; trim() alone knows spaces only."""
    return F.btrim(c, F.lit(SPACES))


def parse(c: Column) -> Column:
    """A stripped text in an array with an end mark: one parse, by which valid() and value() tell whether it is one JSON value, and which."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_END}"]')))


def valid(parsed: Column, c: Column) -> Column:
    """Whether a text is one JSON value and nothing more.

    The parser takes no notice of what follows the array, but for that a text would have to close the array
    itself: then the end mark isn't where it should be. Only a text that holds the mark is parsed again.
    """
    ended = F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == _END, F.lit(False)) & F.try_variant_get(parsed, "$[2]", "variant").isNull()
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull()
    return F.when(c.contains(_END), inside("[", "]") & inside('{"x":', "}")).otherwise(ended)


def value(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$[0]", "variant")


def is_json(c: Column) -> Column:
    return valid(parse(c), c)


def kind(v: Column) -> Column:
    """The type name of a variant: OBJECT<...>, ARRAY<...>, STRING and so on; null for an absent one."""
    return F.schema_of_variant(v)


def fields(v: Column) -> Column:
    """The fields of a JSON object as a map; null for anything else."""
    return F.try_variant_get(v, "$", OBJECT)


def items(v: Column) -> Column:
    """The items of a JSON list; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def string_at(m: Column, key: str) -> Column:
    """The string under a key; null if there is something else or nothing."""
    return F.when(kind(at(m, key)) == "STRING", F.try_variant_get(at(m, key), "$", "string"))


def has_key(m: Column, key: str) -> Column:
    """Whether an object has a key, be its value null."""
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def first_string(m: Column, keys: Iterable[str]) -> Column:
    """The first string among keys that isn't blank."""
    found = (string_at(m, k) for k in keys)
    return F.coalesce(*(F.when(strip(s) != "", s) for s in found), F.lit(None).cast("string"))


def barrier() -> Column:
    """A cheap column that isn't deterministic: beside it a projection is evaluated once, whatever is done with its columns."""
    return F.spark_partition_id().alias("_at")


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """names[c], or c itself."""
    if not names:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c), c)


def sanitize_name(c: Column) -> Column:
    """A name fit for a file: no reserved characters or white space, 'unnamed' if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"(?U)[\s\x1c-\x1f]+", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(plain == "", "unnamed").otherwise(plain)


def redact_url(c: Column) -> Column:
    """A URL without user and password."""
    return F.regexp_replace(c, r"(https?://)[^/@\s]+@", "$1")


def classify_url(url: Column, hf: Column | None = None, mode: Column | None = None) -> Column:
    """hf, url_raw, url_github_clone or url_github_tree of an entry, of which hf or url is set; an error for a URL that no connector takes, and for neither."""
    low = F.lower(url)
    raw = low.contains(_HOSTS_RAW) | low.endswith(".json") | low.endswith(".jsonl") | low.endswith(".json.gz")
    clone = F.lit(False) if mode is None else F.coalesce(mode == "clone", F.lit(False))
    out = F.when(raw, "url_raw").when(low.contains("github.com") & clone, "url_github_clone").when(low.contains("github.com"), "url_github_tree")
    if hf is not None:
        out = F.when(F.coalesce(hf != "", F.lit(False)), "hf").otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no connector for "), F.coalesce(redact_url(url), F.lit("an entry without hf and url")))))


def raw_suffix(url: Column) -> Column:
    """.json.gz, .jsonl or .json as a URL ends; .jsonl for others."""
    low = F.lower(url)
    return F.when(low.endswith(".json.gz"), ".json.gz").when(low.endswith(".json"), ".json").otherwise(".jsonl")


def repo_of(url: Column) -> Column:
    """(owner, repo) of a repository's URL, without .git and what follows; null for others."""
    pattern = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/?#]+?)(?:\.git)?(?:/.*)?$"
    plain = strip(url)
    return F.when(plain.rlike(pattern), F.struct(F.regexp_extract(plain, pattern, 1).alias("owner"), F.regexp_extract(plain, pattern, 2).alias("repo")))
