"""Scalar functions of the catalogs, as column expressions.

The lookup tables are fixed values that say what a reader method decodes to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pascal_case(name: Column) -> Column:
    """Upper-cases the first letter of each part between characters that aren't letters or digits; tails keep their case."""
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def snake_case(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def synthetic_enum_name(members: Column) -> Column:
    """ENUM_ and the sorted distinct members, upper-cased and without other characters than letters and digits."""
    clean = F.transform(members, lambda m: F.upper(F.regexp_replace(m, "[^A-Za-z0-9]", "")))
    return F.concat(F.lit("ENUM_"), F.array_join(F.array_sort(F.array_distinct(clean)), "_"))


def constant_case(name: Column) -> Column:
    """Whether a name is all capitals, digits and underscores, from a letter on."""
    return name.rlike("^[A-Z][A-Z0-9_]*$")


def stripped_operation(name: Column, prefixes: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """A name without the first matching prefix and suffix; it never becomes empty."""
    out = F.regexp_replace(name, f"^(?:{'|'.join(prefixes)})(?=.)", "") if prefixes else name
    return F.regexp_replace(out, f"(?<=.)(?:{'|'.join(suffixes)})$", "") if suffixes else out


def last_segment(url: Column) -> Column:
    """The part of a URL's path after its last slash, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)$", 1)


def file_name(url: Column) -> Column:
    """A safe name on disk: the last segment with other characters as '_'."""
    return F.regexp_replace(last_segment(url), "[^A-Za-z0-9._-]", "_")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1)


def resolved_url(base: Column, ref: Column) -> Column:
    """A reference made absolute: with a scheme, without one (//), from the root (/), or beside the base."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    beside = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    return F.when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(origin(base), ref)).otherwise(F.concat(beside, ref))


def unescaped(text: Column) -> Column:
    """JSON's escaped slash and HTML's ampersand, as they stand in URLs of pages."""
    return F.replace(F.replace(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit("\\u0025"), F.lit("%")), F.lit("&amp;"), F.lit("&"))


def byte_truncated(text: Column, most: int) -> Column:
    """The longest start of a text of at most `most` UTF-8 bytes, cut between characters."""
    chars = F.split(text, "")
    step = lambda a, c: F.when(a["open"] & (a["n"] + F.octet_length(c) <= most), F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["out"], c).alias("out"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["out"].alias("out"), F.lit(False).alias("open")))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(True).alias("open"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.aggregate(chars, start, step, lambda a: a["out"]))


def version_name(revision: Column) -> Column:
    return F.concat(F.lit("2.3000."), revision.cast("string"))


#: What reader methods decode to; other readers give text.
ACCESSOR_TYPES = {
    "attrEnum": "enum", "attrEnumValues": "enum", "attrStringEnum": "enum", "contentStringEnum": "enum", "contentEnum": "enum", "attrEnumOrNullIfUnknown": "enum",
    "attrInt": "integer", "attrTime": "integer", "attrIntRange": "integer", "attrFutureTime": "integer", "contentInt": "integer", "contentUint": "integer",
    "contentBytes": "bytes", "contentBytesRange": "bytes", "contentLiteralBytes": "bytes",
    "attrUserJid": "userJid", "attrPhoneUserJid": "userJid", "attrLidUserJid": "lidUserJid", "attrDeviceJid": "deviceJid", "attrPhoneDeviceJid": "deviceJid", "attrLidDeviceJid": "lidDeviceJid",
    "attrGroupJid": "groupJid", "attrNewsletterJid": "newsletterJid", "attrCallJid": "callJid", "attrBroadcastJid": "broadcastJid", "attrStatusJid": "statusJid",
    "attrJidWithType": "jidTyped", "attrJidEnum": "jidTyped", "attrFromJidChat": "jidTyped", "attrFromJidPhoneChat": "jidTyped",
    "attrWapJid": "jid", "attrChatJid": "jid", "attrFromJid": "jid", "attrJid": "jid", "literalJid": "jid", "attrPhoneChatJid": "jid", "attrDomainJid": "jid", "attrLidJid": "jid", "attrFromPhoneJid": "jid",
}
#: Of the enum readers, which give null for a value outside their set, and which reject it.
NULL_READERS = ("attrEnumOrNullIfUnknown",)
REJECTING_READERS = ("attrEnum", "attrEnumValues", "attrStringEnum", "contentEnum", "contentStringEnum")


def _chosen(key: Column, table: dict[str, str]) -> Column:
    """The value of a key in a small fixed table; null for others."""
    pairs = iter(table.items())
    first, value = next(pairs)
    return reduce(lambda c, p: c.when(key == p[0], p[1]), pairs, F.when(key == first, value))


def plain_name(name: str) -> str:
    """maybeAttrInt is attrInt, as a plain text."""
    return name[5].lower() + name[6:] if name.startswith("maybe") and len(name) > 5 else name


def plain_accessor(name: Column) -> Column:
    """maybeAttrInt is attrInt, as far as its type goes."""
    tail = F.substring(name, 6, 1 << 30)
    return F.when(name.rlike("^maybe."), F.concat(F.lower(F.substring(tail, 1, 1)), F.substring(tail, 2, 1 << 30))).otherwise(name)


def accessor_kind(name: Column) -> Column:
    """child, content, attr or other; by the start of the plain name."""
    n = plain_accessor(name)
    return F.when(n.rlike("^(?:child|children|mapChildren|forEachChild|hasChild)"), "child").when(n.startswith("content"), "content").when(n.rlike("^(?:attr|hasAttr)"), "attr").otherwise("other")


def accessor_optional(name: Column) -> Column:
    return name.startswith("maybe")


def accessor_type(name: Column) -> Column:
    """The decoded type of a reader; text by default, so that an unknown one shows."""
    return F.coalesce(_chosen(plain_accessor(name), ACCESSOR_TYPES), F.lit("string"))


def unknown_policy(name: Column, have: Column | None = None) -> Column:
    """What a value outside an enum reader's set does: null, reject, or unclassified for a reader that isn't listed; null for other readers. A policy that is there already stays."""
    n = plain_accessor(name)
    policy = F.when(accessor_type(name) == "enum", F.when(n.isin(*NULL_READERS), "null").when(n.isin(*REJECTING_READERS), "reject").otherwise("unclassified"))
    return policy if have is None else F.coalesce(have, policy)


#: Starts, ends and whole names that tell a scalar's type.
BOOLEAN_STARTS = ("is_", "has_", "can_", "should_", "allow_", "are_", "was_", "did_", "fetch_", "include_", "enable", "disable")
BOOLEAN_ENDS = ("_enabled", "_disabled", "_allowed", "_required")
NUMBER_ENDS = ("_count", "_time", "_timestamp", "_ts", "_at", "_secs", "_seconds", "_ms", "_index", "_size", "_width", "_height", "_duration", "_revision", "_version", "_number")
NUMBER_NAMES = ("count", "index", "size", "width", "height", "duration", "timestamp", "limit", "offset", "version")


def heuristic_type(name: Column) -> Column:
    """A scalar's type from its name: boolean, number, or string by default."""
    boolean = name.rlike(f"^(?:{'|'.join(BOOLEAN_STARTS)})") | name.rlike(f"(?:{'|'.join(BOOLEAN_ENDS)})$") | (name == "enabled")
    number = name.rlike(f"(?:{'|'.join(NUMBER_ENDS)})$") | name.isin(*NUMBER_NAMES)
    return F.when(boolean, "boolean").when(number, "number").otherwise("string")


def variable_type(name: Column) -> Column:
    """The type of an input variable of which nothing else is known: names in _ids and _jids are lists of text."""
    return F.when(name.rlike("_j?ids$"), "[string]").otherwise(heuristic_type(name))


#: Words that an identifier may not be, and those of them that can't be marked as raw.
RESERVED = (
    "as", "break", "const", "continue", "crate", "else", "enum", "extern", "false", "fn", "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return",
    "self", "Self", "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "while", "async", "await", "dyn", "abstract", "become", "box", "do", "final", "macro",
    "override", "priv", "typeof", "unsized", "virtual", "yield",
)
NEVER_RAW = ("self", "Self", "crate", "super")


def identifier(name: Column) -> Column:
    """A name that can be an identifier: not empty, no digit first, and marked where it is a reserved word."""
    base = F.when(name == "", "_").when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)
    return F.when(base.isin(*NEVER_RAW), F.concat(base, F.lit("_"))).when(base.isin(*RESERVED), F.concat(F.lit("r#"), base)).otherwise(base)


def snake_identifier(name: Column) -> Column:
    return identifier(snake_case(name))


def telemetry_pascal(name: Column) -> Column:
    """Words between other characters than letters and digits, and where a capital follows a small letter; each begins with a capital and goes on in small letters."""
    parts = F.filter(F.split(F.regexp_replace(name, "([a-z])(?=[A-Z])", "$1_"), "[^A-Za-z0-9]+"), lambda p: p != "")
    return identifier(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), ""))


def quoted(text: Column) -> Column:
    """A text as a literal of generated code, between double quotes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\0", "0")):
        out = F.replace(out, F.lit(char), F.lit(f"\\{name}"))
    other = F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"^[\x01-\x1F\x7F]$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x01-\x1F\x7F]"), F.array_join(other, "")).otherwise(out), F.lit('"'))


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes as %XX, but for letters, digits and - _ . ~ and the comma."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2C", ",")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def integer_text(value: Column) -> Column:
    """A whole number as scripts write it, without fraction and sign of zero; null for other numbers, and from 1e21 on, where they write exponents."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e21), F.when(value == 0, "0").otherwise(value.cast("decimal(38,0)").cast("string")))


def default_text(value: Column) -> Column:
    """A numeric default: whole numbers below 2^53 without fraction, others in plain decimals."""
    plain = F.rtrim(value.cast("decimal(38,18)").cast("string"), F.lit("0"))
    text = value.cast("string")
    return F.when((value == F.floor(value)) & (F.abs(value) < 9007199254740992.0), value.cast("long").cast("string")).when(F.contains(text, F.lit("E")), plain).otherwise(text)


def hex_bytes(text: Column) -> Column:
    """The bytes of an even number of hex digits; null for anything else."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(text))


def proto_nested_name(name: Column) -> Column:
    """Outer$Inner as Outer.Inner, without the marker of specifications."""
    return F.replace(F.regexp_replace(name, r"Spec$", ""), F.lit("$"), F.lit("."))


def bit_meaning(value: Column) -> Column:
    """What a bit position stands for: 1 << value."""
    return F.when(value.between(0, 62), F.call_function("shiftleft", F.lit(1).cast("long"), value.cast("int")))
