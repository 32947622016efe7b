"""Text, path, date and JSON scalars. Every function returns a ``Column``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F, types as T

# What counts as white space at the ends of a text, and the
# words that count as "no value" inside a joined list.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_WORDS = ("", "none", "null", "nan", "0")
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
UPLOAD_PREFIXES = ("/var/www/", "/home/", "./uploads/", "../uploads/")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use at several places of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Drop every kind of white space at both ends (``trim`` drops blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a value. Doubles are plain from 1e-4 to below 1e16, else scientific with a two-digit exponent."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        def plain(kind: str) -> Column:
            return F.regexp_replace(c.cast(kind).cast("string"), r"(\.\d+?)0+$", "$1")

        size = F.abs(c)
        short = F.regexp_replace(c.cast("string"), r"\.0E", "E")
        padded = F.regexp_replace(F.regexp_replace(short, r"E-(\d)$", "E-0$1"), r"E(\d)$", "E0$1")
        power = F.replace(padded, F.lit("E"), F.when(size < 1, "e").otherwise("e+"))
        return (F.when((size >= 1e7) & (size < 1e16), plain("decimal(38,10)"))
                .when((size >= 1e-4) & (size < 1e-3), plain("decimal(38,25)"))
                .when(((size > 0) & (size < 1e-4)) | ((size >= 1e16) & (size < float("inf"))), power)
                .otherwise(c.cast("string")))
    return c.cast("string")


def clean(c: Column, dtype: T.DataType | None = None) -> Column:
    """Cell to text: NULL becomes empty, nested values JSON, the rest stripped text."""
    return F.coalesce(strip(as_text(c, dtype or T.StringType())), F.lit(""))


def informative(c: Column) -> Column:
    """True when a cleaned text is more than blank, none, null, nan or 0."""
    return ~F.lower(c).isin(*BLANK_WORDS)


def join_nonblank(parts: Sequence[Column], sep: str = " · ") -> Column:
    """Join cleaned texts, leaving out those without a value."""
    return F.concat_ws(sep, *[F.when(informative(p), p) for p in parts])


def title_label(c: Column) -> Column:
    """Readable label of an identifier."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def title_of(name: str) -> str:
    """:func:`title_label` for a column name known when the plan is built."""
    return " ".join(word[:1].upper() + word[1:].lower() for word in name.replace("_", " ").split(" "))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def terms(c: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(c))


def parse_score(c: Column, default: float = 5.0) -> Column:
    """First number of a free text."""
    number = F.regexp_extract(c, r"([0-9][0-9.]*)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(default))


def parse_yesno(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("yes"))


def parse_timestamp(c: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First format that fits the stripped text, NULL when none does."""
    body = strip(c)
    return F.coalesce(*[F.try_to_timestamp(body, F.lit(f)).cast("timestamp_ntz") for f in formats])


def html_to_text(c: Column) -> Column:
    """Text runs between tags joined by a blank; script bodies and entities stay."""
    def run(piece: Column, i: Column) -> Column:
        close = F.instr(piece, ">")
        inner = F.when(close == 0, F.lit("")).otherwise(
            F.replace(piece.substr(close + 1, F.length(piece)), F.lit(">"), F.lit(""))
        )
        return F.when(i == 0, F.replace(piece, F.lit(">"), F.lit(""))).otherwise(inner)

    runs = F.transform(F.split(c, "<"), run)
    return strip(F.array_join(F.filter(runs, lambda r: r != ""), " "))


def decode_bytes(c: Column) -> Column:
    """Bytes to text: UTF-8 when valid, Latin-1 otherwise."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def file_extension(path: Column, explicit: Column | None = None) -> Column:
    """An explicit type wins over the path suffix; lower case, without dots in front."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))
    if explicit is None:
        return suffix
    stated = F.ltrim(F.lower(strip(explicit)), F.lit("."))
    blank = F.coalesce(strip(explicit), F.lit("")) == ""
    return F.when(blank, suffix).otherwise(stated)


def url_unquote(c: Column) -> Column:
    """Percent decoding that keeps ``+``; NULL for a malformed escape."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def base64_text(c: Column) -> Column:
    """Base64 to text; NULL when it is no base64 or no UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(c, F.lit("base64")).cast("string"))


def path_candidates(path: Column, prefixes: Sequence[str] = UPLOAD_PREFIXES) -> Column:
    """Places to look for a file, best first: ``array<struct<prio, candidate>>``."""
    bare = strip(path)
    unquoted = url_unquote(bare)
    places = [bare, base64_text(bare), F.when(unquoted != bare, unquoted)]
    places += [F.concat(F.lit(p), basename(bare)) for p in prefixes]
    numbered = [F.struct(F.lit(i).alias("prio"), p.alias("candidate")) for i, p in enumerate(places)]
    found = F.filter(F.array(*numbered), lambda s: s["candidate"].isNotNull())
    return F.when(F.coalesce(bare, F.lit("")) != "", found)


def chunk_sliding(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Character windows; a last window inside the one before it is left out."""
    step = size - overlap

    def windows(t: Column) -> Column:
        last = F.greatest(F.ceil((F.length(t) - size) / F.lit(step)), F.lit(0)).cast("bigint")
        cut = F.transform(F.sequence(F.lit(0).cast("bigint"), last),
                          lambda i: t.substr((i * step + 1).cast("int"), F.lit(size)))
        return F.when(F.length(t) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(c, windows)


def parse_json_array(c: Column, schema: str) -> Column:
    """The JSON array inside a (fenced) model answer as ``array<struct>``; NULL without one."""
    bare = strip(F.regexp_replace(c, "```(?:json)?", ""))
    return F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), schema)
