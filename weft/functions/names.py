"""Names of things: prefixes, compact and full forms, display names, stable names from ids, words for a search."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Well-known prefixes.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "obo": "http://purl.obolibrary.org/obo/",
    "oboInOwl": "http://www.geneontology.org/formats/oboInOwl#",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "https://schema.org/",
}
# The words of code names, and the digits of base 62.
ADJECTIVES = ("brisk", "calm", "clever", "crisp", "daring", "eager", "fuzzy", "gentle", "jolly", "lively", "mellow", "nimble", "plucky", "quiet", "spry", "swift")
NOUNS = ("otter", "lynx", "falcon", "badger", "koala", "panda", "beaver", "ram", "heron", "bison", "orca", "eagle", "python", "tiger", "yak", "ibis")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def expanded(name: Column, prefixes: Mapping[str, str] = NAMESPACES) -> Column:
    """The full IRI of a CURIE; IRIs (in angle brackets or not), blank nodes and names without a known prefix stay."""
    text = F.trim(name)
    known = F.create_map(*(F.lit(x) for pair in prefixes.items() for x in pair))
    base = F.try_element_at(known, F.substring_index(text, ":", 1))
    local = F.regexp_replace(text, "^[^:]*:", "")
    bare = F.regexp_replace(text, "^<(.*)>$", "$1")
    return F.when(F.startswith(text, F.lit("_:")) | F.contains(text, F.lit("://")) | F.startswith(text, F.lit("<")), bare).when(base.isNotNull() & F.contains(text, F.lit(":")), F.concat(base, local)).otherwise(text)


def compacted(iri: Column, prefixes: Mapping[str, str] = NAMESPACES) -> Column:
    """prefix:local by the longest namespace that begins the IRI and leaves a plain local name; else <iri>; blank nodes stay."""
    out = F.when(F.startswith(iri, F.lit("_:")), iri).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))
    for prefix, base in sorted(prefixes.items(), key=lambda p: len(p[1])):
        local = F.substring(iri, F.lit(len(base) + 1), F.length(iri))
        out = F.when(F.startswith(iri, F.lit(base)) & local.rlike("^[^/#:]+$"), F.concat(F.lit(f"{prefix}:"), local)).otherwise(out)
    return out


def _bare(name: Column) -> Column:
    return F.trim(F.trim(F.coalesce(name, F.lit(""))), F.lit("<>"))


def local_name(name: Column) -> Column:
    """What follows the last # and / of an IRI, or the colon of a CURIE; other names and blank nodes stay."""
    s = _bare(name)
    return F.when(F.contains(s, F.lit("://")), F.regexp_replace(F.regexp_replace(s, "^.*#", ""), "^.*/", "")).when(F.contains(s, F.lit(":")) & ~F.startswith(s, F.lit("_:")), F.regexp_replace(s, "^[^:]*:", "")).otherwise(s)


def display_name(labels: Column, iri: Column, name: Column, node: Column) -> Column:
    """The first label, or the local part of the IRI (or name), or the node's id."""
    return F.coalesce(F.trim(F.get(labels, F.lit(0))), F.nullif(local_name(F.coalesce(F.nullif(iri, F.lit("")), name)), F.lit("")), node)


def namespace_of(name: Column) -> Column:
    """An IRI up to its last #, or else its last /, with it; null for other names."""
    s = _bare(name)
    hashed, slashed = F.regexp_extract(s, "^(.*#)", 1), F.regexp_extract(s, "^(.*/)", 1)
    return F.when(F.contains(s, F.lit("://")), F.when(F.contains(s, F.lit("#")), F.when(hashed != "#", hashed)).otherwise(F.when(slashed != "/", slashed)))


def member_names(members: Column, labels: bool = False) -> Column:
    """Members (array of struct name, labels, alt_labels) of a class, joined by a comma: by name, or by label."""
    shown = lambda m: F.coalesce(F.get(m["labels"], F.lit(0)), F.get(m["alt_labels"], F.lit(0)), F.regexp_replace(m["name"], "^.*/", "")) if labels else m["name"]
    return F.array_join(F.transform(members, shown), ", ")


def search_term(term: Column) -> Column:
    """The last part of a path, with blanks for underscores."""
    return F.translate(F.element_at(F.split(F.coalesce(term, F.lit("")), "/"), -1), "_", " ")


def representative(terms: Column, otherwise: Column) -> Column:
    """The most readable of terms: one that does not look like an identifier before one that does, then the shortest, then the first."""
    trimmed = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))
    looks = lambda t: t.rlike(r"https?://|^obo:|^[A-Z_]+\d+$|[_/]|^\w+:\w+$")
    ranked = F.transform(trimmed, lambda t, i: F.struct(F.when(looks(t), 1).otherwise(0).alias("flag"), F.length(t).alias("length"), i.alias("at"), t.alias("term")))
    return F.coalesce(F.array_min(ranked)["term"], otherwise)


def _base62(number: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out.rjust(22, DIGITS[0])


def name_from_uuid(value: str, style: str = "codename") -> str:
    """A stable name of a UUID: slug (base 64), slug62, slug32, or two words and four hex digits."""
    raw = uuid.UUID(value)
    if style == "slug":
        return base64.urlsafe_b64encode(raw.bytes).decode().rstrip("=")
    if style in ("slug62", "slug_alnum"):
        return _base62(raw.int)
    if style == "slug32":
        return base64.b32encode(raw.bytes).decode().rstrip("=")
    first, second, *rest = hashlib.blake2b(raw.bytes, digest_size=4).digest()
    return "-".join((ADJECTIVES[first % len(ADJECTIVES)], NOUNS[second % len(NOUNS)], bytes(rest).hex()))


def uuid_name(column: Column, style: str = "codename") -> Column:
    """name_from_uuid() of each value; null where it is no UUID. base 64 stays an expression."""
    digits = F.regexp_replace(F.lower(F.trim(column)), "[{}-]|^urn:uuid:", "")
    if style == "slug":
        return F.when(digits.rlike("^[0-9a-f]{32}$"), F.rtrim(F.translate(F.base64(F.unhex(digits)), "+/\r\n", "-_"), F.lit("=")))

    @F.pandas_udf("string")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: name_from_uuid(v, style) if isinstance(v, str) and len(v) == 32 else None)

    return named(F.when(digits.rlike("^[0-9a-f]{32}$"), digits))


