"""Text functions: folding, keys, parsing of charges, digests. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, both the comma-below and the cedilla forms.
ACCENTED = "ăâîșşțţáàäéèêëíìïóòöôúùüûçñĂÂÎȘŞȚŢÁÀÄÉÈÊËÍÌÏÓÒÖÔÚÙÜÛÇÑß"
PLAIN = "aaissttaaaeeeeiiioooouuuucnAAISSTTAAAEEEEIIIOOOOUUUUCNs"


def fold(text: Column) -> Column:
    """Without accents, in upper case, trimmed."""
    return F.upper(F.trim(F.translate(text, ACCENTED, PLAIN)))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(fold(text), "[^A-Z]", "")


def alnum_key(text: Column) -> Column:
    """Runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(fold(text), "[^A-Z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """Lower case, with runs of white space made one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r]+", " "))


def null_if_blank(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def strip_code(text: Column) -> Column:
    """A code without a decimal tail or leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "\\.0$", ""), "^0+([0-9])", "$1")


def strip_suffix(text: Column) -> Column:
    """A case number without its ancillary suffix."""
    return F.regexp_replace(text, "/a[0-9]+$", "")


def significant_tokens(text: Column, shortest: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of the key that are long enough and no stop words, in order."""
    words = F.filter(F.split(alnum_key(text), " "), lambda w: F.length(w) >= shortest)
    words = F.filter(words, lambda w: ~w.isin([s.upper() for s in stop])) if stop else words
    return F.array_sort(F.array_distinct(words))


def salted_digest(text: Column, salt: str) -> Column:
    """A name's digest under a secret salt; the same folded name has the same digest."""
    return F.sha2(F.concat_ws("|", F.lit(salt), fold(text)), 256)


def redact(name: Column, legal: Column, sealed: Column) -> Column:
    """The name of a legal person in an open case, and nothing else."""
    return F.when(legal & ~sealed, name)


def scrub(text: Column) -> Column:
    """Without the characters that XML does not allow."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def first_prefix(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule whose prefix the text has."""
    out = F.lit(otherwise)
    for prefix, label in reversed(rules):
        out = F.when(text.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def has_code_prefix(code: Column, prefix: str) -> Column:
    """The code itself or one below it in a dotted hierarchy."""
    return (code == prefix) | code.startswith(prefix + ".")


def html_script_json(html: Column, script_id: str) -> Column:
    """The content of the script element of an id."""
    return F.regexp_extract(html, f'<script[^>]*id="{script_id}"[^>]*>([^<]*)</script>', 1)


def slug(text: Column) -> Column:
    """Lower case, with one dash for each run of anything but letters and digits."""
    return F.trim(F.lower(F.regexp_replace(fold(text), "[^A-Z0-9]+", "-")), F.lit("-"))


def statute_source(text: Column) -> Column:
    """The law of a charge as number/year, or the penal code; null where it names neither."""
    law = F.regexp_extract(text, "nr\\. ([0-9]+/[0-9]{4})", 1)
    return F.when(law != "", law).when(text.rlike("C\\.pen\\.|NCP"), "penal code")


def statute_article(text: Column) -> Column:
    return F.regexp_extract(text, "^art\\. ?([0-9]+)", 1).try_cast("int")


def is_address(text: Column) -> Column:
    """A kind of street at the start, or a house number after a name."""
    return text.rlike("(?i)^(str|strada|b-dul|bd|calea|aleea|piata)[. ]") | text.rlike("(?i)[a-z] nr\\. ?[0-9]+")


def _single_byte(text: Column, charset: str) -> Column:
    """Text that was read as Latin-1, as of another charset of single bytes; what that does not define stays."""
    pairs = [(chr(b), bytes([b]).decode(charset, "replace")) for b in range(128, 256)]
    pairs = [(a, b) for a, b in pairs if b not in (a, "\ufffd")]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def charset(raw: Column) -> Column:
    """The first of utf-8-sig, utf-8, cp1250 and iso-8859-2 that can read the bytes; the last reads any."""
    marked = F.hex(F.substring(raw, 1, 3)) == "EFBBBF"
    undefined = F.decode(raw, "ISO-8859-1").rlike("[\\x81\\x83\\x88\\x90\\x98]")
    return F.when(~F.is_valid_utf8(raw.cast("string")), F.when(undefined, "iso-8859-2").otherwise("cp1250")).when(marked, "utf-8-sig").otherwise("utf-8")


def decoded(raw: Column) -> Column:
    """Bytes as text of their charset, without a byte order mark."""
    kind, latin = charset(raw), F.decode(raw, "ISO-8859-1")
    out = F.when(kind == "utf-8", raw.cast("string")).when(kind == "utf-8-sig", F.substring(raw, 4, 2_147_483_647).cast("string"))
    return out.when(kind == "cp1250", _single_byte(latin, "cp1250")).otherwise(_single_byte(latin, "iso-8859-2"))


def flattened(text: Column) -> Column:
    """The folded forms of a name in which an accented a-circumflex was made a or i."""
    return F.array_distinct(F.array(*[fold(F.translate(text, "Ââ", plain)) for plain in ("Aa", "Ii")]))


def join_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Letters and digits of a folded name, in which spellings of two registers meet; an alias stands for another key. Aliases are
    given as keys."""
    key = F.regexp_replace(fold(name), "[^A-Z0-9]", "")
    if not aliases:
        return key
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), key)


def titles(cell: Column, heads: str) -> Column:
    """The titles of a cell as a struct (kind, titles, qualifier); heads is a regular expression for the words that a title begins
    with, matched on the folded text.

    Semicolons, else commas, else slashes separate titles where every part begins like one. After the last semicolon's title a
    comma may bring in a qualifier of all of them (kind mixed). A cell whose semicolons part something else stays whole and needs
    a review; without separators, or where commas and slashes part something else, it is a single title. Blank cells have none.
    """
    raw = F.trim(F.regexp_replace(cell, "\\s+", " "))
    raw = F.trim(F.regexp_replace(raw, "^[;,\\s]+|[;,\\s]+$", ""))
    is_title = lambda t: fold(t).rlike(f"^(?:{heads})\\b")

    def parts(separator: str) -> Column:
        cut = F.transform(F.split(raw, separator), lambda p: F.regexp_replace(p, "^[ .;,/]+|[ .;,/]+$", ""))
        return F.filter(cut, lambda p: p != "")

    by_semicolon, by_comma, by_slash = parts(";"), parts(","), parts("/")
    last = F.element_at(by_semicolon, -1)
    head, tail = F.trim(F.substring_index(last, ",", 1)), F.trim(F.regexp_replace(last, "^[^,]*,", ""))
    qualified = last.contains(",") & is_title(head) & ~is_title(tail)
    own = F.when(qualified, F.concat(F.slice(by_semicolon, 1, F.size(by_semicolon) - 1), F.array(head))).otherwise(by_semicolon)
    every = lambda a: (F.size(a) > 1) & F.forall(a, is_title)
    none = F.lit(None).cast("string")
    make = lambda kind, found, qualifier=none: F.struct(F.lit(kind).alias("kind"), found.alias("titles"), qualifier.alias("qualifier"))
    single = make("single", F.array(raw))
    semicolon = F.when(F.size(by_semicolon) < 2, single).when(~every(own), make("needs_review", F.array(raw))).when(qualified, make("mixed", own, tail)).otherwise(make("semicolon", own))
    comma = F.when(every(by_comma), make("comma", by_comma)).otherwise(single)
    slash = F.when(every(by_slash), make("slash", by_slash)).otherwise(single)
    some = F.when(raw.contains(";"), semicolon).when(raw.contains(","), comma).when(raw.contains("/"), slash).otherwise(single)
    return F.when(F.coalesce(raw, F.lit("")) != "", some).otherwise(make("single", F.array().cast("array<string>")))


def best_prefix(known: Column, code: Column) -> Column:
    """The value of the longest key of a map that a code begins with; null without one."""
    keys = F.array_sort(F.transform(F.filter(F.map_keys(known), lambda k: F.startswith(code, k)), lambda k: F.struct((-F.length(k)).alias("l"), k.alias("k"))))
    return F.when(F.size(keys) > 0, F.try_element_at(known, F.get(keys, F.lit(0))["k"]))


def has_dimensions(known: Column, wanted: dict[str, str]) -> Column:
    """Whether a map has every wanted dimension at its value; it may have others."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(known, F.lit(k)) == v, F.lit(False))
    return out
