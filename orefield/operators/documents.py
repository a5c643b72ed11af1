"""Tables of pages and texts, and vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_text, fold_key, plain_words

PIECE = 1 << 15  # characters of a text whose passages one row gives
PIECES = 32  # such rows that a task takes

#: An anchor with its attributes and what is between its tags; the href among attributes, in any place and quoting.
ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a\s*>"
HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def extract_links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, position, href, text, resolved): the anchors with an href of each page, markup inside their text dropped; an href beginning with / is resolved against the page's host."""
    each = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)))
    found = pages.select(key, url, F.posexplode(F.filter(each, lambda a: a["0"].rlike(HREF))).alias("position", "z"))
    quoted = [F.nullif(F.regexp_extract("z.0", HREF, n), F.lit("")) for n in (1, 2, 3)]
    href = F.coalesce(*quoted, F.lit(""))
    host = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    links = found.select(key, "position", href.alias("href"), F.regexp_replace("z.1", "<[^>]*>", "").alias("text"), host.alias("_host"))
    return links.withColumn("resolved", F.when(F.col("href").startswith("/"), F.concat("_host", "href")).otherwise(F.col("href"))).drop("_host")


class _Tables(HTMLParser):
    """Cells of all tables of a page. Each open table has its own place and, while a cell of it is open, its own text, so a table inside a cell does not end the cell."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[tuple[int, int, int, str]] = []
        self.open: list[dict] = []
        self.n = 0
        self.silent = 0  # inside scripts and styles

    def end_cell(self) -> None:
        t = self.open[-1]
        if t["text"] is not None:
            self.cells.append((t["table"], t["row"], t["col"], " ".join("".join(t["text"]).split())))
        t["text"] = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "table":
            self.open.append({"table": self.n, "row": -1, "col": -1, "text": None})
            self.n += 1
        if not self.open:
            return
        t = self.open[-1]
        if tag == "tr":
            self.end_cell()
            t["row"], t["col"] = t["row"] + 1, -1
        elif tag in ("td", "th"):
            self.end_cell()
            t["row"], t["col"], t["text"] = max(t["row"], 0), t["col"] + 1, []
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if self.open and tag in ("td", "th", "tr", "table"):
            self.end_cell()
            if tag == "table":
                self.open.pop()
                self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def finish(self) -> list[tuple[int, int, int, str]]:
        self.close()
        while self.open:
            self.end_cell()
            self.open.pop()
        return sorted(self.cells, key=lambda c: c[:3])


#: A tag that HTMLParser reads as just this, whatever stands around it, as attributes do not matter for tables.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s+[a-zA-Z][a-zA-Z-]*=(?:"[^"<>]*"|'[^'<>]*'))*\s*>""")
#: Elements whose content is not read as markup.
RAW = {"script", "style", "textarea", "title", "plaintext", "iframe", "noembed", "noframes", "noscript", "xmp"}


def _cells(page: str) -> list[tuple[int, int, int, str]]:
    parser, parts = _Tables(), TAG.split(page)
    tags = [t.lower() for t in parts[2::3]]
    if page.count("<") > len(tags) or not RAW.isdisjoint(tags):  # comments, references in tags, scripts and whatever else
        parser.feed(page)
        return parser.finish()
    for data, slash, tag in zip(parts[0::3], parts[1::3], tags):
        if data and parser.open:
            parser.handle_data(unescape(data) if "&" in data else data)
        (parser.handle_endtag if slash else parser.handle_starttag)(tag, *() if slash else ((),))
    parser.handle_data(unescape(parts[-1]))
    return parser.finish()


def extract_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, text) of all HTML tables, in the order of their start tags.

    A table inside a cell is a table of its own; the cell keeps its own text before and after it. Breaks and blocks count as a space, character references are decoded, scripts
    and styles are left out. Tables that the page does not close end with it. Only pages with a table reach Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for n, page in enumerate(batch.column(1).to_pylist()):
                found = _cells(page)
                cells += found
                at += [n] * len(found)
            table, row, col, text = zip(*cells) if cells else ((),) * 4
            columns = [batch.column(0).take(pa.array(at, "int64")), *[pa.array(c, "int32") for c in (table, row, col)], pa.array(text, "string")]
            yield pa.RecordBatch.from_arrays(columns, [key, "table", "row", "col", "text"])

    with_table = pages.select(key, html).where(F.lower(html).contains("<table"))
    return with_table.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, table int, row int, col int, text string")


def canonical_headers(cells: DataFrame, keys: Sequence[str], rules: Mapping[str, str], within: int = 5) -> DataFrame:
    """(keys, row, one column for each field): the first row among the first few with the most header matches names the columns below it.

    rules: field -> pattern on the lower-case header text (several languages as alternatives). cells are read once: a table's cells go to one task, where
    windows that spill find the header row and the fields of each column.
    """
    field = reduce(lambda acc, kv: acc.when(F.lower("text").rlike(kv[1]), kv[0]), rules.items(), F.when(F.lit(False), "")).otherwise(None)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "col")])
    dealt = cells.select(*keys, "row", "col", "text").where(known).repartition(*keys).withColumn("_f", F.when(F.col("row") < within, field))
    matches = F.size(F.collect_set("_f").over(Window.partitionBy(*keys, "row")))
    table = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = dealt.withColumn("_n", matches).withColumn("_h", F.min(F.when(F.col("_n") > 0, F.struct(-F.col("_n"), "row"))).over(table)["row"])
    named = placed.withColumn("_fields", F.collect_set(F.when(F.col("row") == F.col("_h"), F.col("_f"))).over(Window.partitionBy(*keys, "col")))
    body = named.where((F.col("row") > F.col("_h")) & (F.size("_fields") > 0))
    return body.groupBy(*keys, "row").agg(*[F.min(F.when(F.array_contains("_fields", f), F.nullif(F.col("text"), F.lit("")))).alias(f) for f in rules])


def extract_fields(docs: DataFrame, key: str, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, each field's first hit, each field's hits): patterns in order of trust, group 1."""
    out = []
    for f, own in patterns.items():
        hits = [F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(1)) for p in own]
        together = F.concat(*hits) if len(hits) > 1 else hits[0]
        out += [F.get(together, F.lit(0)).alias(f), together.alias(f"all_{f}")]
    return docs.select(key, *out)


def melt_measurements(wide: DataFrame, keys: Sequence[str], parameters: Sequence[str], metadata: DataFrame) -> DataFrame:
    """(keys, parameter, value, method, unit, conflict): one row for each sample and parameter with its method; conflict if the metadata gives several units.

    metadata: (parameter, method, unit).
    """
    long = wide.unpivot(list(keys), list(parameters), "parameter", "value")
    meta = metadata.groupBy("parameter").agg(F.min("method").alias("method"), F.min("unit").alias("unit"), (F.countDistinct("unit") > 1).alias("conflict"))
    return long.join(meta, "parameter", "left").select(*keys, "parameter", "value", "method", "unit", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def build_entities(seeds: DataFrame) -> DataFrame:
    """(key, name, kind, parents, sources, n_mentions, rank): one entity for each folded name; the first seed defines, later ones enrich.

    seeds: (seed_order, name, kind, parent, source).
    """
    keyed = seeds.withColumn("key", fold_key("name")).where("key <> ''")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("name", "kind"), F.struct("seed_order", "name")).alias("d"), F.sort_array(F.collect_set("parent")).alias("parents"), F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n_mentions"))
    from .relational import running_number

    return running_number(first.select("key", "d.name", "d.kind", "parents", "sources", "n_mentions"), [F.desc("n_mentions"), F.col("key")], "rank")


def map_terms(terms: DataFrame, term: str, vocabularies: Mapping[str, DataFrame], separators: str, drop: str) -> DataFrame:
    """terms with targets (sorted), method and status: the whole term, then its components, against each vocabulary (key, target) in order.

    A component takes the first vocabulary that knows it; drop is a pattern of words left out of components.
    """
    whole = terms.select(term).distinct().withColumn("_key", fold_key(term)).withColumn("_kind", F.lit("whole"))
    parts = terms.select(term).distinct().select(term, F.explode(F.split(F.col(term), separators)).alias("_p")).select(term, fold_key(clean_text(F.regexp_replace("_p", drop, ""))).alias("_key"), F.lit("component").alias("_kind"))
    asked = whole.unionByName(parts).where("_key <> ''")
    known = reduce(DataFrame.unionByName, [v.select(F.col("key").alias("_key"), F.col("target").alias("_t"), F.lit(i).alias("_order"), F.lit(n).alias("_v")) for i, (n, v) in enumerate(vocabularies.items())])
    hits = asked.join(known, "_key").withColumn("_first", F.min("_order").over(Window.partitionBy(term, "_kind", "_key"))).where("_order = _first")
    found = hits.groupBy(term).agg(F.sort_array(F.collect_set("_t")).alias("targets"), F.array_join(F.sort_array(F.collect_set(F.concat_ws("_", "_v", "_kind"))), "+").alias("method"))
    return terms.join(found, term, "left").select(*terms.columns, F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), F.coalesce("method", F.lit("none")).alias("method"), F.when(F.col("targets").isNotNull(), "mapped").otherwise("unresolved").alias("status"))


def expand_occurrences(chapters: DataFrame, region: str, places: str, text: str) -> DataFrame:
    """(region, term, place, place_found): nested map term -> places as rows, each place looked for in the chapter's text as term_found() does.

    A text is not searched once for each place: its passages of the places' lengths are rows that meet the places in an equi-join. So the work is that of the text's
    length times the number of different lengths. Passages come from pieces of the text in tasks of their own.
    """
    whole = chapters.withColumn("_hay", plain_words(text)).withColumn("_t", F.unhex(F.sha2("_hay", 256)))  # equal texts share a search
    each = whole.select(region, "_t", F.explode(places).alias("term", "_places")).select(region, "_t", "term", F.explode("_places").alias("place")).withColumn("_needle", plain_words("place"))
    squeezed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    both = lambda c: F.explode(F.array(F.struct(F.lit(False).alias("s"), F.col(c).alias("v")), F.struct(F.lit(True).alias("s"), squeezed(c).alias("v")))).alias("_f")
    asked = each.where("_needle <> ''").select("_t", "_needle").distinct().select("_t", "_needle", both("_needle")).select("_t", "_needle", F.col("_f.s").alias("_s"), F.col("_f.v").alias("_v")).where("not _s or length(_v) >= 6")
    lengths = asked.groupBy("_t", "_s").agg(F.collect_set(F.length("_v")).alias("_lengths"))
    texts = whole.select("_t", "_hay").distinct().select("_t", both("_hay")).select("_t", F.col("_f.s").alias("_s"), F.col("_f.v").alias("_hay"))
    step = F.greatest(F.lit(PIECE), F.array_max("_lengths"))
    pieces = texts.join(lengths.hint("merge"), ["_t", "_s"]).withColumn("_step", step).withColumn("_from", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_hay"), F.lit(1)), F.col("_step"))))
    pieces = pieces.select("_t", "_s", "_step", F.substring(F.col("_hay"), F.col("_from"), 2 * F.col("_step")).alias("_piece"), F.explode("_lengths").alias("_n"))
    own = F.substring(F.col("_piece"), F.lit(1), F.col("_step") + F.col("_n") - 1)  # passages that begin before the next piece
    n = pieces.count() // PIECES + 1
    passages = pieces.repartition(n).select("_t", "_s", F.explode(F.array_distinct(F.regexp_extract_all(own, F.format_string("(?=(.{%d}))", "_n"), F.lit(1)))).alias("_v")).repartition(n, "_t", "_s", "_v")
    found = asked.join(passages.hint("merge"), ["_t", "_s", "_v"], "left_semi").select("_t", "_needle").distinct().withColumn("_found", F.lit(True))
    return each.join(found.hint("merge"), ["_t", "_needle"], "left").select(region, "term", "place", (F.coalesce("_found", F.lit(False)) | (F.col("_needle") == "")).alias("place_found"))
