"""Stored catalogue pages to typed rows.

A Python function only reads strings out of the HTML tree, as the selectors below say; types, dates, cleaning, required
fields and file-name checks are DataFrame expressions on its result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions import scalars

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes, and its children (elements and text) in order."""

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    @cached_property
    def classes(self) -> frozenset[str]:
        return frozenset(self.attributes.get("class", "").split())

    @cached_property
    def below(self) -> list[Node]:
        """All elements below, in page order; walked once."""
        return list(self.elements())

    def elements(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


PART = re.compile(r"""^([a-z0-9]*)((?:\.[\w-]+)*)(?:\#([\w-]+))?(?:\[([\w-]+)=['"]([^'"]*)['"]\])?$""")


@lru_cache(maxsize=1024)
def steps(selector: str) -> list[tuple]:
    """The steps of a selector: tag, classes, id, one attribute and its value."""
    parts = [PART.match(part).groups() for part in selector.split(" ")]
    return [(tag, frozenset(c for c in classes.split(".") if c), id_, attribute, value) for tag, classes, id_, attribute, value in parts]


def matches(node: Node, step: tuple) -> bool:
    tag, classes, id_, attribute, value = step
    return (not tag or node.tag == tag) and (not classes or classes <= node.classes) and (not id_ or node.attributes.get("id") == id_) and (not attribute or node.attributes.get(attribute) == value)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` by a chain of descendant steps, in page order and once each."""
    found = [root]
    for step in steps(selector):
        seen: set[int] = set()
        found = [n for r in found for n in r.below if matches(n, step) and id(n) not in seen and not seen.add(id(n))]
    return found


#: What to read: (selector, take) for one value, [selector, take] for a list, {name: ...} with "" for a list of records.
#: ``take`` is "text" or an attribute.
Spec = dict[str, object]

# Selectors of the page format.
ALBUM: Spec = {
    "name": ("meta[itemprop='name']", "content"),
    "rating": ("meta[itemprop='ratingValue']", "content"),
    "rating_count": ("meta[itemprop='ratingCount']", "content"),
    "links": ("#media_link_button_container_top", "data-links"),
    "date": (".issue_year.ymd", "title"),
    "body": (".release_page", "tag"),
    "cover": (".release_page .page_release_art_frame img", "src"),
    "artists": {"": ".release_page span[itemprop='byArtist'] a", "name": ("", "text"), "href": ("", "href")},
    "primary": [".release_page .release_pri_genres .genre", "text"],
    "secondary": [".release_page .release_sec_genres .genre", "text"],
    "descriptors": [".release_page .release_descriptors meta", "content"],
    "info": {"": ".release_page .album_info tr", "title": ("th", "text"), "value": ("td", "text")},
    "tracks": {"": "#tracks .tracklist_line", "name": (".rendered_text", "text"), "rating": (".track_rating_avg", "text"), "position": (".tracklist_num", "text"), "seconds": (".tracklist_duration meta", "data-inseconds")},
    "credits": {"": "#credits_ li", "name": ("a", "text"), "href": ("a", "href"), "roles": {"": ".role_name", "text": ("", "text"), "tracks": (".role_tracks", "text")}},
}
CHART: Spec = {
    "items": {
        "": ".page_charts_section_charts_item",
        "name": (".page_charts_section_charts_item_title .ui_name_locale_original", "text"),
        "rating": (".page_charts_section_charts_item_details_average_num", "text"),
        "artists": {"": ".page_charts_section_charts_item_credited_links_primary a", "name": ("", "text"), "href": ("", "href")},
        "primary": [".page_charts_section_charts_item_genres_primary a", "text"],
        "secondary": [".page_charts_section_charts_item_genres_secondary a", "text"],
        "href": (".page_charts_section_charts_item_link", "href"),
        "date": (".page_charts_section_charts_item_date span", "text"),
    }
}
ARTIST: Spec = {"name": ("meta[itemprop='name']", "content")} | {f"section_{s}": {"": f"#disco_type_{s} .album", "name": ("", "text"), "href": ("", "href")} for s in "smec"}
SEARCH: Spec = {"items": {"": ".infobox", "name": (".searchpage", "text"), "href": (".searchpage", "href"), "artists": {"": ".artist", "name": ("", "text"), "href": ("", "href")}}}
LIST: Spec = {"name": ("h1", "text"), "bars": {"": ".navspan", "pages": [".navlinknum", "href"]}, "albums": [".list_album", "href"]}
SPECS = {"album": ALBUM, "chart": CHART, "artist": ARTIST, "album_search_result": SEARCH, "list_segment": LIST}


def take(node: Node, what: str) -> str | None:
    if what == "tag":
        return node.tag
    return node.text() if what == "text" else node.attributes.get(what)


def read(root: Node, spec: Spec) -> dict:
    """The strings that a spec asks for below an element."""
    out: dict = {}
    for name, rule in spec.items():
        if name == "":
            continue
        if isinstance(rule, dict):
            out[name] = [read(node, rule) for node in select(root, rule[""])]
        else:
            selector, what = rule
            nodes = select(root, selector) if selector else [root]
            values = [take(n, what) for n in nodes]
            out[name] = [v for v in values if v is not None] if isinstance(rule, list) else next(iter(values), None)
    return out


def reader(specs: dict[str, Spec]):  # noqa: ANN201
    """The function (html, page type) that reads the strings of each page as JSON; null for an unknown type or no page."""

    @F.pandas_udf(T.StringType())
    def read_page(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, kinds in parts:
            yield pd.Series([json.dumps(read(parse(p), specs[k])) if p is not None and k in specs else None for p, k in zip(pages, kinds, strict=True)], dtype="object")

    # Filters on the result must not run the function again.
    return read_page.asNondeterministic()


REFERENCE = "array<struct<name:string,href:string>>"
RAW = {
    "album": f"name string, rating string, rating_count string, links string, date string, body string, cover string, artists {REFERENCE}, primary array<string>, secondary array<string>, descriptors array<string>, info array<struct<title:string,value:string>>, tracks array<struct<name:string,rating:string,position:string,seconds:string>>, credits array<struct<name:string,href:string,roles:array<struct<text:string,tracks:string>>>>",
    "chart": f"items array<struct<name:string,rating:string,artists:{REFERENCE},primary:array<string>,secondary:array<string>,href:string,date:string>>",
    "artist": f"name string, section_s {REFERENCE}, section_m {REFERENCE}, section_e {REFERENCE}, section_c {REFERENCE}",
    "album_search_result": f"items array<struct<name:string,href:string,artists:{REFERENCE}>>",
    "list_segment": "name string, bars array<struct<pages:array<string>>>, albums array<string>",
}


#: Tasks of reading for each core: enough for an even end.
TASKS_A_CORE = 4


def read_pages(pages: DataFrame, kinds: list[str] | None = None, file_name: str = "file_name", html: str = "html", parts: dict[str, list[str]] | None = None) -> DataFrame:
    """(file_name, page_type, raw): pages of the types asked for (all known ones for none given) with their strings as JSON,
    each read once. Pages of other types aren't read. Of types in ``parts`` only those parts of the whole page are taken
    (see ``SPECS``); what comes from others is then null."""
    rows = pages.select(F.col(file_name).alias("file_name"), scalars.page_type(F.col(file_name)).alias("page_type"), F.col(html).alias("html")).where("page_type is not null and html is not null")
    rows = rows if kinds is None else rows.where(F.col("page_type").isin(kinds))
    # Reading takes far longer than moving a page, so its tasks go by the cores and not by the few bytes that are moved.
    rows = rows.repartition(TASKS_A_CORE * pages.sparkSession.sparkContext.defaultParallelism, F.xxhash64("file_name"))
    specs = {kind: {name: spec[name] for name in (parts or {}).get(kind, spec)} for kind, spec in SPECS.items()}
    return rows.select("file_name", "page_type", reader(specs)("html", "page_type").alias("raw"))


def _references(values: Column) -> Column:
    """Names and file names of links; a link that is no file name has a null one."""
    return F.transform(values, lambda a: F.struct(scalars.clean_artist_name(a["name"]).alias("name"), scalars.normal_file_name(a["href"]).alias("file_name")))


def _of_type(raw: DataFrame, kind: str) -> DataFrame:
    return raw.where(F.col("page_type") == kind).select("file_name", F.from_json("raw", RAW[kind]).alias("r")).select("file_name", "r.*")


def _number(text: Column, kind: str) -> Column:
    """A number, 0 if it can't be read."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def albums(raw: DataFrame) -> DataFrame:
    """Album rows, with ``error`` set where a required part is missing."""
    r = _of_type(raw, "album")
    artists = _references(F.col("artists"))
    language = F.flatten(
        F.transform(
            F.filter("info", lambda i: i["title"].isin("Language", "Languages") & i["value"].isNotNull()),
            lambda i: F.when(i["title"] == "Language", F.array(i["value"])).otherwise(F.split(F.replace(i["value"], F.lit(" "), F.lit("")), ",")),
        )
    )
    services = F.from_json("links", "map<string,map<string,struct<default:boolean>>>")["spotify"]
    credit = F.transform(
        F.filter("credits", lambda c: scalars.normal_file_name(c["href"]).isNotNull()),
        lambda c: F.struct(
            F.struct(scalars.clean_artist_name(c["name"]).alias("name"), scalars.normal_file_name(c["href"]).alias("file_name")).alias("artist"),
            F.transform(c["roles"], lambda x: F.trim(F.when(x["tracks"].isNull() | (x["tracks"] == ""), x["text"]).otherwise(F.replace(x["text"], x["tracks"], F.lit(""))))).alias("roles"),
        ),
    )
    error = (
        F.when(F.col("name").isNull(), "missing name").when(F.col("rating").isNull(), "missing ratingValue").when(F.col("rating_count").isNull(), "missing ratingCount")
        .when(F.col("body").isNull(), "missing release page").when(F.exists(artists, lambda a: a["file_name"].isNull()), "bad artist link")
    )
    return r.select(
        "file_name", F.replace("name", F.lit("’"), F.lit("'")).alias("name"), _number(F.col("rating"), "float").alias("rating"), _number(F.col("rating_count"), "int").alias("rating_count"),
        artists.alias("artists"), F.col("primary").alias("primary_genres"), F.col("secondary").alias("secondary_genres"), "descriptors",
        F.transform("tracks", lambda t: F.struct(t["name"].alias("name"), t["seconds"].try_cast("int").alias("duration_seconds"), t["rating"].try_cast("float").alias("rating"), t["position"].alias("position"))).alias("tracks"),
        scalars.release_date(F.col("date")).alias("release_date"), language.alias("languages"), credit.alias("credits"), F.concat(F.lit("https:"), "cover").alias("cover_image_url"),
        F.get(F.map_keys(F.map_filter(services, lambda k, v: v["default"])), F.lit(0)).alias("spotify_id"), error.alias("error"),
    )


def chart_albums(raw: DataFrame) -> DataFrame:
    """One row an item of a chart; items without name, rating, primary genres or album link are left out."""
    i = _of_type(raw, "chart").select(F.col("file_name").alias("chart"), F.posexplode("items").alias("position", "i")).select("chart", "position", "i.*")
    rows = i.select(
        "chart", "position", scalars.normal_file_name(F.col("href")).alias("file_name"), "name", F.col("rating").try_cast("float").alias("rating"),
        F.filter(_references(F.col("artists")), lambda a: a["file_name"].isNotNull() & a["name"].isNotNull()).alias("artists"),
        F.col("primary").alias("primary_genres"), F.col("secondary").alias("secondary_genres"), scalars.release_date(F.col("date")).alias("release_date"),
    )
    return rows.where("file_name is not null and name is not null and rating is not null and primary_genres is not null")


def artists(raw: DataFrame) -> DataFrame:
    """Artists with the albums of their four sections in order; a missing section, or one with a bad link, is empty."""

    def section(name: str) -> Column:
        found = F.transform(name, lambda a: F.struct(a["name"].alias("name"), scalars.normal_file_name(a["href"]).alias("file_name")))
        return F.when(F.exists(found, lambda a: a["file_name"].isNull()), F.slice(found, 1, 0)).otherwise(found)

    r = _of_type(raw, "artist")
    return r.select("file_name", "name", F.concat(*[section(f"section_{s}") for s in "smec"]).alias("albums"), F.when(F.col("name").isNull(), "missing name").alias("error"))


def search_results(raw: DataFrame) -> DataFrame:
    """The first hit of each search page that is an album."""
    found = F.transform("items", lambda i: F.struct(i["name"].alias("name"), scalars.normal_file_name(i["href"]).alias("file_name"), F.filter(_references(i["artists"]), lambda a: a["file_name"].isNotNull()).alias("artists")))
    first = F.get(F.filter(found, lambda i: i["name"].isNotNull() & (scalars.page_type(i["file_name"]) == "album")), F.lit(0))
    r = _of_type(raw, "album_search_result").select(F.col("file_name").alias("search"), first.alias("hit"))
    return r.select("search", "hit.name", "hit.file_name", "hit.artists", F.when(F.col("hit").isNull(), "no album in the search results").alias("error"))


def list_segments(raw: DataFrame) -> DataFrame:
    """List pages with the other pages of the first page bar and their albums, in order."""
    names = lambda c: F.filter(F.transform(c, scalars.normal_file_name), lambda n: n.isNotNull())
    r = _of_type(raw, "list_segment")
    pages = F.coalesce(F.get("bars", F.lit(0))["pages"], F.array().cast("array<string>"))
    return r.select("file_name", scalars.list_root(F.col("file_name")).alias("root_file_name"), "name", names(pages).alias("other_segments"), names(F.col("albums")).alias("albums"), F.when(F.col("name").isNull(), "missing name").alias("error"))


def parse_errors(r: dict[str, Column]) -> dict[str, Column]:
    """What is missing in a page of each type, from its strings; null if nothing is. Charts leave items out instead."""
    album, artist, search, listing = (r[kind] for kind in ("album", "artist", "album_search_result", "list_segment"))
    is_album = lambda i: i["name"].isNotNull() & (scalars.page_type(scalars.normal_file_name(i["href"])) == "album")
    return {
        "album": F.when(album["name"].isNull(), "missing name").when(album["rating"].isNull(), "missing ratingValue").when(album["rating_count"].isNull(), "missing ratingCount")
        .when(album["body"].isNull(), "missing release page").when(F.exists(album["artists"], lambda a: scalars.normal_file_name(a["href"]).isNull()), "bad artist link"),
        "artist": F.when(artist["name"].isNull(), "missing name"),
        "album_search_result": F.when(~F.coalesce(F.exists(search["items"], is_album), F.lit(False)), "no album in the search results"),
        "list_segment": F.when(listing["name"].isNull(), "missing name"),
    }


#: The parts of a page that decide whether its parse fails.
DECIDING = {"album": ["name", "rating", "rating_count", "body", "artists"], "chart": [], "artist": ["name"], "album_search_result": ["items"], "list_segment": ["name"]}


def parse_events(raw: DataFrame) -> DataFrame:
    """(file_name, page_type, event, error): what each page's parse reports to the event log, in one pass. It needs the
    parts ``DECIDING`` alone."""
    rows = raw
    for kind in SPECS:  # a page has the strings of its own type only
        rows = rows.withColumn(f"r_{kind}", F.when(F.col("page_type") == kind, F.from_json("raw", RAW[kind])))
    error = F.lit(None).cast("string")
    for kind, missing in parse_errors({kind: F.col(f"r_{kind}") for kind in SPECS}).items():
        error = F.when(F.col("page_type") == kind, missing).otherwise(error)
    rows = rows.withColumn("error", error)
    return rows.select("file_name", "page_type", F.when(F.col("error").isNull(), "FileParsed").otherwise("FileParseFailed").alias("event"), "error")


@F.pandas_udf(T.StructType().add("title", T.StringType()).add("headings", T.ArrayType(T.StringType())).add("links", T.ArrayType(T.StringType())))
def outline(pages: pd.Series) -> pd.DataFrame:
    """Title, first-level headings and link targets of any page."""
    rows = []
    for page in pages:
        root = parse(page or "")
        title = select(root, "title")
        rows.append((title[0].text() if title else None, [n.text() for n in select(root, "h1")], [n.attributes["href"] for n in select(root, "a") if "href" in n.attributes]))
    return pd.DataFrame(rows, columns=["title", "headings", "links"])
