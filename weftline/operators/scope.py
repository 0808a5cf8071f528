"""Which captured paths, pictures and sources count: conservative predicates as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of files and folders without records; licenses of pictures.
DOCUMENTS = (
    "readme",
    "readme_header",
    "agents",
    "claude",
    "contributing",
    "contributers",
    "credits",
    "code_of_conduct",
    "code-of-conduct",
    "security",
    "maintainers",
    "development",
    "changelog",
    "index",
    "writing",
    "about",
    "template",
    "license",
    "copying",
)
FOLDERS = (
    "docs",
    "tips",
    "basics",
    "experiments",
    "templates",
    "_layouts",
    "_includes",
    "_posts",
    "l10n",
    "locale",
    "lang",
    "frontend",
    "vue3",
    "calculator",
    "flowchart",
    "http.d",
    "nginx",
)
TEST_FOLDERS = ("testdata/", "test_data/", "tests/data/", "res_jsonld/", "res_microdata/")
LICENSES = (
    "CC0-1.0",
    "CC-BY-2.0",
    "CC-BY-3.0",
    "CC-BY-4.0",
    "CC-BY-SA-2.0",
    "CC-BY-SA-3.0",
    "CC-BY-SA-4.0",
    "CC-BY-NC-3.0",
    "CC-BY-NC-4.0",
    "CC-BY-NC-SA-3.0",
    "CC-BY-NC-SA-4.0",
    "PUBLIC-DOMAIN",
    "MIT",
)
FREE_LICENSES = ("CC0-1.0", "PUBLIC-DOMAIN")
SOURCE_STATUS = {"blocked": "BLOCKED", "unsupported": "UNSUPPORTED", "disabled": "NOT_A_RECIPE_SOURCE", "not-a-recipe-source": "NOT_A_RECIPE_SOURCE"}


def may_hold_records(path: Column) -> Column:
    """A path outside what was planned that someone should look at. Archives always, documents about a project never."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    lower = F.lower(path)
    kind = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    aside = stem.isin(*DOCUMENTS) | F.exists(parts, lambda p: p.startswith(".")) | F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS)))
    tested = F.lit(False)
    for folder in TEST_FOLDERS:
        tested = tested | F.contains(lower, F.lit(folder))
    return (
        F.when(kind.isin(".zip", ".gz", ".paprikarecipe", ".recipe"), True).when(aside, False).when(kind.isin(".md", ".markdown", ".mdx"), True)
        .when(kind == ".csv", F.contains(lower, F.lit("migration")) | F.contains(stem, F.lit("recipe"))).when(kind.isin(".json", ".html"), tested & ~F.contains(lower, F.lit("report"))).otherwise(False)
    )


def source_status(status: Column, pending: Column, failures: Column, gaps: Column, error: Column) -> Column:
    """A stated status of the source, else what its counts tell."""
    out = F.when(status == "blocked", SOURCE_STATUS["blocked"])
    for name, label in list(SOURCE_STATUS.items())[1:]:
        out = out.when(status == name, label)
    return out.when(error.isNotNull(), "BLOCKED").when((pending > 0) | (failures > 0) | (gaps > 0), "PARTIAL").otherwise("COMPLETE")


def public_url(url: Column) -> Column:
    """http or https with a host, no user, no blanks; false for null."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#@\s:]+(?::[0-9]*)?(?:[/?#]\S*)?$"), F.lit(False))


def picture(*candidates: Column) -> Column:
    """The first candidate that may be shown: struct<url, source_url, attribution, license>, else null.

    candidates: structs of url, source_url, attribution, license, publication_allowed, permission_evidence. A license of a
    picture's own needs an attribution unless it is free; an explicit permission needs a public proof. A second
    candidate must be the same record's (see same_identity); a record's license never stands for its picture's."""

    def shown(c: Column) -> Column:
        name = F.upper(c["license"])
        licensed = F.coalesce(name.isin(*LICENSES), F.lit(False))
        named = F.coalesce(F.trim(c["attribution"]) != "", F.lit(False)) | name.isin(*FREE_LICENSES)
        allowed = F.coalesce(c["publication_allowed"], F.lit(False)) & public_url(c["permission_evidence"])
        fits = F.coalesce(c["publication_allowed"], F.lit(True)) & public_url(c["url"]) & public_url(c["source_url"]) & F.when(licensed, named).otherwise(allowed)
        attribution = F.when(c["attribution"] != "", c["attribution"])
        license_ = F.coalesce(F.when(c["license"] != "", c["license"]), F.lit("Explicit permission"))
        return F.when(fits, F.struct(c["url"].alias("url"), c["source_url"].alias("source_url"), attribution.alias("attribution"), license_.alias("license")))

    return F.coalesce(*map(shown, candidates))


def same_identity(candidate: Column, own_id: Column, its_id: Column) -> Column:
    """candidate only where its record is the own one."""
    return F.when(own_id == its_id, candidate)


def public_product_id(url: Column, domain: str, pattern: str) -> Column:
    """The id that pattern's first group finds in the path of a URL of this host or below it; else null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    found = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), pattern, 1)
    return F.when(F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False)) & (found != ""), found)


def group_basis(stated: Column, terms: list[str], source: Column, inferred: dict[str, str]) -> Column:
    """struct<kind, value>: why a record belongs to a group: its own words, or what is known of its source; else null."""
    explicit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(stated, F.lit(""))), t))
    out = F.when(explicit, F.struct(F.lit("explicit").alias("kind"), stated.alias("value")))
    for part, why in inferred.items():
        out = out.when(F.contains(F.coalesce(source, F.lit("")), F.lit(part)), F.struct(F.lit("source-inference").alias("kind"), F.lit(why).alias("value")))
    return out
