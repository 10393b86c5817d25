"""XMP packets and IPTC records of an image, as maps from a field's name to the JSON text of its value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stages import let

#: Numbers and names of data sets in the second record of the IPTC information interchange model.
IPTC_FIELDS = {
    5: "ObjectName", 15: "Category", 20: "SupplementalCategories", 25: "Keywords", 40: "SpecialInstructions", 55: "DateCreated", 60: "TimeCreated", 80: "Byline", 85: "BylineTitle", 90: "City",
    92: "Sublocation", 95: "State", 100: "CountryCode", 101: "Country", 103: "OriginalTransmissionReference", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 118: "Contact",
    120: "Caption", 122: "CaptionWriter",
}
_FROM, _TO = "<x:xmpmeta", "</x:xmpmeta>"
#: How a Photoshop block of resources announces IPTC records.
_RESOURCE = "8BIM\x04\x04"
_ROUNDS, _ROUND = (64,), 1024
_PAIRS = "array<struct<key:string,value:string>>"
NO_FIELDS = "map<string,string>"


def no_fields() -> Column:
    return F.create_map().cast(NO_FIELDS)


def xmp_packet(content: Column) -> Column:
    """The text of the first XMP packet in a file of any format, found by the tags around it; null if there is none.

    Packets that are compressed or not in UTF-8 are not found.
    """
    before = F.substring_index(content.cast("string"), _TO, 1)
    packet = lambda b: F.when(b.contains(_FROM) & (F.octet_length(b) < F.length(content)), F.concat(F.lit(_FROM), F.substring_index(b, _FROM, -1), F.lit(_TO)))
    return let(before, packet)


def _value(v: Column) -> Column:
    """JSON of a property: text and numbers as they are, a list's only item alone, and of items with attributes the text."""
    listed = F.coalesce(*(F.try_variant_get(v, f"$['rdf:{kind}']['rdf:li']", "variant") for kind in ("Seq", "Bag", "Alt")), v)
    bare = lambda text: F.regexp_replace(text, r'(?<!\\)"_?[A-Za-z][A-Za-z0-9]*:([^"\\]*)":', '"$1":')  # names inside, without prefix
    plain = lambda x: bare(F.to_json(F.coalesce(F.try_variant_get(x, "$._VALUE", "variant"), x)))
    items = lambda x: F.try_variant_get(x, "$", "array<variant>")
    many = lambda all_: F.when(F.size(all_) == 1, plain(all_[0])).otherwise(F.concat(F.lit("["), F.array_join(F.transform(all_, plain), ","), F.lit("]")))
    return let(listed, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), let(items(x), many)).otherwise(plain(x)))


def _first_wins(pairs: Column) -> Column:
    """A map of pairs (key, value), with the first of several values of a key."""
    first = lambda all_, keys: F.map_from_entries(F.filter(all_, lambda p, i: (F.array_position(keys, p["key"]) == i + 1) & p["value"].isNotNull()))
    return let(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()), lambda all_: first(all_, F.transform(all_, lambda p: p["key"])))


def xmp_fields(content: Column) -> Column:
    """Properties of the XMP packet by their names without prefix; empty where there is no packet or it can't be parsed."""
    # A packet that isn't well formed would end the job where it becomes a variant, so it is read with a schema first.
    sound = lambda p: F.when(F.from_xml(p, "`rdf:RDF` string, broken string", {"columnNameOfCorruptRecord": "broken"})["broken"].isNull(), p)
    tree = F.from_xml(let(xmp_packet(content), sound), F.lit("variant"))
    at = "$['rdf:RDF']['rdf:Description']"
    described = lambda t: F.coalesce(F.try_variant_get(t, at, "array<map<string,variant>>"), F.array(F.try_variant_get(t, at, "map<string,variant>")))
    entries = F.flatten(F.transform(F.array_compact(let(tree, described)), F.map_entries))
    own = F.filter(entries, lambda e: ~e["key"].rlike("^_?(xmlns|rdf|xml)(:|$)") & e["key"].contains(":"))
    pairs = F.transform(own, lambda e: F.struct(F.substring_index(e["key"], ":", -1).alias("key"), _value(e["value"]).alias("value")))
    return F.coalesce(_first_wins(pairs), no_fields())


def _iptc_block(content: Column) -> Column:
    """The IPTC records in a block of Photoshop resources; null if there are none."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at + 1, F.lit(n))), 16, 10).cast("int")
    start = F.octet_length(F.substring_index(content.cast("string"), _RESOURCE, 1)) + len(_RESOURCE)
    body = lambda at: at + 2 * F.floor((number(at, 1) + 2) / 2).cast("int")  # noqa: E731  # a name with its length, to an even number of bytes
    block = lambda at: F.substring(content, at + 5, number(at, 4))
    return let(start, lambda at: F.when(at < F.length(content), let(body(at), block)))


def _text(value: Column) -> Column:
    return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise(F.decode(value, "ISO-8859-1"))


def iptc_fields(content: Column) -> Column:
    """IPTC records by the names of their data sets, in JPEG files and others with Photoshop resources; several values of one as an array.

    A fold over the records that carries the place of the next one and what has been found.
    """
    names = F.create_map(*(F.lit(x) for kv in IPTC_FIELDS.items() for x in kv))

    def step(block: Column, s: Column) -> Column:
        def read(head: Column) -> Column:
            size = F.conv(F.substring(head, 7, 4), 16, 10).cast("int")
            name = F.when(F.substring(head, 3, 2) == "02", F.try_element_at(names, F.conv(F.substring(head, 5, 2), 16, 10).cast("int")))
            pair = F.struct(name.alias("key"), _text(F.substring(block, s["at"] + 6, size)).alias("value"))
            ends = (F.length(head) < 10) | ~head.startswith("1C") | (s["at"] + 5 + size > F.length(block))
            found = F.when(ends | name.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(pair)))
            return F.struct(F.when(ends, -1).otherwise(s["at"] + 5 + size).alias("at"), found.alias("found"))

        return F.when(s["at"] < 0, s).otherwise(let(F.hex(F.substring(block, s["at"] + 1, F.lit(5))), read))

    def records(block: Column) -> Column:
        rounds = F.concat(F.array(*map(F.lit, _ROUNDS)), F.array_repeat(F.lit(_ROUND), (F.length(block) / (5 * _ROUND)).cast("int") + 1))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_PAIRS).alias("found"))
        walk = lambda s, n: F.when(s["at"] < 0, s).otherwise(F.aggregate(F.sequence(F.lit(1), n), s, lambda t, _: step(block, t)))
        return F.aggregate(rounds, start, walk)["found"]

    def fields(found: Column) -> Column:
        of = lambda key: F.transform(F.filter(found, lambda p: p["key"] == key), lambda p: p["value"])
        quoted = lambda values: F.when(F.size(values) == 1, F.regexp_replace(F.to_json(values), r"^\[|\]$", "")).otherwise(F.to_json(values))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(found, lambda p: p["key"])), lambda key: F.struct(key.alias("key"), let(of(key), quoted).alias("value"))))

    return F.coalesce(let(_iptc_block(content), lambda b: F.when(b.isNotNull(), let(records(b), fields))), no_fields())


def merged(*maps: Column) -> Column:
    """One map of several; a key's value is that of the first map that has it."""
    both = lambda a, b: let(a, lambda x: F.map_concat(x, F.map_filter(b, lambda k, _: ~F.map_contains_key(x, k))))
    return reduce(both, maps)
