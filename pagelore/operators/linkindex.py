"""Link index parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.functions import text

LINK = r"^- \[(.+?)\]\(([^)\s]+)\)(?::\s*(.*))?$"


def index_lines(docs: DataFrame, prefix: str = fx.GUIDANCE_PREFIX) -> DataFrame:
    """Lines of each index with the heading above them (X2), each index within its row.

    ``doc_id, pos, line, is_heading, section, section_pos, in_guidance``. The places of the
    headings are found first; each block is the slice of lines from one to the next, so the
    work grows with the lines whatever the number of headings.
    """
    lines = docs.select("doc_id", F.split(F.col("text"), text.LINE_BREAK).alias("lines"))
    heads = F.filter(F.transform("lines", lambda line, i: F.when(line.startswith("## "), i)), lambda i: i.isNotNull())
    placed = lines.select("doc_id", "lines", heads.alias("heads"))

    def block(b: Column) -> Column:
        first = F.coalesce(F.get("heads", b - 1), F.lit(0))
        stop = F.coalesce(F.get("heads", b), F.size("lines"))
        return F.struct(first.alias("first"), (b > 0).alias("headed"), F.slice("lines", first + 1, stop - first).alias("lines"))

    rows = placed.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("heads")), block)).alias("b"))
    headed = F.col("b.headed")
    head = F.get("b.lines", F.lit(0))
    name = F.when(headed, text.strip(F.substring(head, F.lit(4), F.length(head))))
    return rows.select(
        "doc_id", "b.first", headed.alias("headed"), name.alias("name"), F.posexplode("b.lines").alias("n", "line")
    ).select(
        "doc_id", (F.col("first") + F.col("n")).alias("pos"), "line", (F.col("headed") & (F.col("n") == 0)).alias("is_heading"),
        F.coalesce("name", F.lit("")).alias("section"), F.when(F.col("headed"), F.col("first")).alias("section_pos"),
        F.coalesce(F.col("name").startswith(prefix), F.lit(False)).alias("in_guidance"),
    )


def parse_links(lines: DataFrame) -> DataFrame:
    """Link lines outside the guidance section."""
    description = F.nullif(text.strip(F.regexp_extract("line", LINK, 3)), F.lit(""))
    return lines.where(
        ~F.col("is_heading") & ~F.col("in_guidance") & F.col("line").rlike(LINK)
    ).select(
        "doc_id", "pos", "section",
        F.regexp_extract("line", LINK, 1).alias("title"),
        F.regexp_extract("line", LINK, 2).alias("url"),
        description.alias("description"),
    )


def is_host_markdown(url: Column, host: str) -> Column:
    return (text.url_host(url) == host) & text.url_path(url).endswith(".md")


def keep_host_markdown(links: DataFrame, host: str) -> DataFrame:
    return links.where(is_host_markdown(F.col("url"), host))


def dedupe_first(links: DataFrame) -> DataFrame:
    """First listing of each URL; positions count the kept rows only."""
    first = links.groupBy("doc_id", "url").agg(
        F.min_by(F.struct("pos", "section", "title", "description"), "pos").alias("e"))
    kept = first.select("doc_id", "url", "e.*")
    position = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return kept.withColumn("position", position.cast("long")).drop("pos")


def link_index(docs: DataFrame, host: str) -> DataFrame:
    """Index documents -> page entries, in listing order."""
    return dedupe_first(keep_host_markdown(parse_links(index_lines(docs)), host)).select(
        "doc_id", "section", "title", "url", "description", "position")


def sections(lines: DataFrame) -> DataFrame:
    """Section names with their prose, NULL where there is none."""
    own = lines.where(~F.col("in_guidance") & F.col("section_pos").isNotNull())   # also a heading without a name
    body = text.strip(F.col("line"))
    is_prose = ~F.col("is_heading") & ~F.col("line").rlike(LINK) & (body != "")
    grouped = own.groupBy("doc_id", "section_pos").agg(
        F.first("section").alias("name"),
        F.array_sort(F.collect_list(F.when(is_prose, F.struct("pos", body.alias("line"))))).alias("prose"),
    )
    position = F.row_number().over(W.partitionBy("doc_id").orderBy("section_pos")) - 1
    return grouped.select(
        "doc_id", "name",
        F.nullif(F.array_join(F.transform("prose", lambda r: r["line"]), "\n"), F.lit("")).alias("description"),
        position.cast("long").alias("position"),
    )


def guidance_text(lines: DataFrame) -> DataFrame:
    """Text of the guidance section per document."""
    own = lines.where(F.col("in_guidance") & ~F.col("is_heading"))
    grouped = own.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    joined = text.strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return grouped.select("doc_id", joined.alias("guidance"))
