"""Scalar functions of the catalogue as Column expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from the Unicode decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            pairs.append((chr(code), plain))
    pairs += [("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i"), ("ð", "d"), ("Ð", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_fold(text: Column) -> Column:
    """Latin letters without marks; ß, æ, œ and þ become two letters. Other scripts stay as they are."""
    marked, plain = _letters()
    out = F.translate(text, marked, plain)
    for one, two in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH")):
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def query_text(text: Column) -> Column:
    """Folded, in lower case, with everything but letters and digits turned into spaces."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " "))


def terms(text: Column) -> Column:
    """Distinct terms of a text for searching; none for a null or blank text."""
    return F.filter(F.array_distinct(F.split(F.coalesce(query_text(text), F.lit("")), " ")), lambda t: t != "")


def url_tag(name: Column) -> Column:
    """A tag as it stands in a chart address: spaces to hyphens, ampersands to ``and``, lower case."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.lit("&"), F.lit("and"))


def chart_name(kind: str, years: tuple[int, int] | None, include: list[Column]) -> Column:
    """The file name of a chart: kind, year range or all-time, and included tags."""
    span = "all-time" if years is None else (str(years[0]) if years[0] == years[1] else f"{years[0]}-{years[1]}")
    base = F.lit(f"charts/{kind}/album/{span}")
    return F.concat(base, F.lit("/g:"), F.array_join(F.transform(F.array(*include), url_tag), ",")) if include else base


# The forms of file names by page type, tested in this order.
ALBUM_KINDS = ("album", "mixtape", "ep", "comp")
CHART_NAME = r"^charts/(\w+)/(album|mixtape|ep)/"
SEARCH_NAME = r"^search\?searchterm=[^&]+&searchtype=l$"
LIST_NAME = r"^list/(\w+)/([\w-]+)/?(\d*)/?$"


def page_type(file_name: Column) -> Column:
    """album, chart, album_search_result, artist or list_segment by the form of the file name, tested in that order."""
    # \w and \d stand for letters and digits of all scripts, and $ for the very end.
    fits = lambda pattern: file_name.rlike("(?U)" + pattern.replace("$", r"\z"))
    return (
        F.when(file_name.rlike(f"^release/({'|'.join(ALBUM_KINDS)})/"), "album")
        .when(fits(CHART_NAME), "chart")
        .when(fits(SEARCH_NAME), "album_search_result")
        .when(file_name.startswith("artist"), "artist")
        .when(fits(LIST_NAME), "list_segment")
    )


def normal_file_name(name: Column) -> Column:
    """Without outer slashes; a list path of three parts gets its first page; null if no page type fits."""
    bare = F.trim(name, F.lit("/"))
    listed = F.when(bare.rlike("^list/[^/]+/[^/]+$"), F.concat(bare, F.lit("/1"))).otherwise(bare)
    return F.when(page_type(listed).isNotNull(), listed)


def list_root(file_name: Column) -> Column:
    """The first three parts of a list path."""
    return F.array_join(F.slice(F.split(file_name, "/"), 1, 3), "/")


def valid_profile_id(text: Column) -> Column:
    return text.rlike("^[a-zA-Z][a-zA-Z0-9_-]{2,80}$")


def release_date(text: Column) -> Column:
    """``D Month YYYY``, ``Month YYYY`` (its first day) or ``YYYY`` (1 January); null otherwise."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{1,2} [A-Z][a-z]+ \d{4}$"), F.try_to_timestamp(t, F.lit("d MMMM yyyy")).cast("date"))
    month = F.when(t.rlike(r"^[A-Z][a-z]+ \d{4}$"), F.try_to_timestamp(F.concat(F.lit("1 "), t), F.lit("d MMMM yyyy")).cast("date"))
    year = F.when(t.rlike(r"^\d{4}$"), F.make_date(t.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(full, month, year)


def decade(year: Column) -> Column:
    return (year - F.pmod(year, F.lit(10))).cast("int")


def credit_tag(artist_file_name: Column, role: Column) -> Column:
    """``artist:role`` with the role in lower case and underscores for spaces."""
    return F.concat(artist_file_name, F.lit(":"), F.replace(F.lower(role), F.lit(" "), F.lit("_")))


def search_identity(album: Column, artist: Column) -> Column:
    """The key of an album search: base64 of both names in lower case with a delimiter that names don't hold."""
    return F.base64(F.encode(F.concat(F.lower(album), F.lit("␟"), F.lower(artist)), "UTF-8"))


def search_address(album: Column, artist: Column) -> Column:
    """The search page of an album, with the query encoded for a URL."""
    return F.concat(F.lit("search?searchterm="), F.url_encode(F.concat(F.lower(artist), F.lit(" "), F.lower(album))), F.lit("&searchtype=l"))


# The digits of Crockford's base 32.
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_time(ulid: Column) -> Column:
    """The time (milliseconds since 1970) in the first ten digits of a ULID, as a timestamp; null if malformed."""
    value = F.lit(0).cast("long")
    for k in range(1, 11):
        value = value * 32 + F.instr(F.lit(ULID_DIGITS), F.substring(F.upper(ulid), k, 1)) - 1
    return F.when(F.upper(ulid).rlike(f"^[{ULID_DIGITS}]{{26}}$"), F.timestamp_millis(value))


# Days until a stored page of each type is stale.
STALE_AFTER_DAYS = {"artist": 7, "album": 30, "chart": 7, "album_search_result": 7, "list_segment": 7}


def is_stale(file_name: Column, last_saved_at: Column, now: Column) -> Column:
    """True if the page was never saved or was saved longer ago than its type allows."""
    kind, days = page_type(file_name), F.lit(None).cast("int")
    for name, n in STALE_AFTER_DAYS.items():
        days = F.when(kind == name, n).otherwise(days)
    return last_saved_at.isNull() | (now > last_saved_at + F.make_dt_interval(days))


def clean_html(page: Column) -> Column:
    """A page without comments, scripts, styles and inline handlers, with single spaces."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?i)\s(style|onclick)=(\"[^\"]*\"|'[^']*')"):
        page = F.regexp_replace(page, pattern, "")
    return F.trim(F.regexp_replace(page, r"\s+", " "))


def clean_artist_name(name: Column) -> Column:
    """Without a trailing ampersand, encoded or not."""
    return F.trim(F.regexp_replace(name, r"\s*(&amp;|&)\s*$", ""))


def chunks_of_words(text: Column, most: int) -> Column:
    """The words of a text in lines of at most ``most`` characters (a longer word has a line of its own)."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        fits = (state["line"] == "") | (F.length(state["line"]) + 1 + F.length(word) <= most)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["line"]))).alias("done"),
            F.when(state["line"] == "", word).when(fits, F.concat(state["line"], F.lit(" "), word)).otherwise(word).alias("line"),
        )

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, empty, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))


def default_if_zero(value: Column, default: Column) -> Column:
    """``default`` for null, NaN and zero."""
    return F.when(value.isNull() | F.isnan(value) | (value == 0), default).otherwise(value)
