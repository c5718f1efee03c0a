"""Pages -> sections -> chunks (C1-C6). A page is one row and is cut inside it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.fixed_values import MAX_CHARS, MIN_CHARS, OVERLAP_CHARS
from pagelore.functions import packing, text

def split_sections(pages: DataFrame, key: str = "url", content: str = "content",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Cut pages at ``#``..``####`` headings outside fences (C1), each page in its row.

    Returns ``key, section_id, heading_path, text`` and the columns in ``keep``.
    Heading lines are dropped, and so are sections without text.
    """
    @F.pandas_udf("array<struct<section_id:long,heading_path:string,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            {"section_id": n, "heading_path": path, "text": body} for n, path, body in packing.cut_sections(t)])

    cuts = pages.where(F.col(content).isNotNull()).select(key, *keep, F.explode(cut(content)).alias("s"))
    return cuts.select(key, *keep, "s.section_id", "s.heading_path", "s.text")


def pack_section(col: Column, cap: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Bounded pieces of one section's text (C2, C3), as ``array<string>``."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packing.pack_section(t, cap, overlap))

    return pack(col)


def slice_long_lines(col: Column, cap: int = MAX_CHARS) -> Column:
    """Slices of at most ``cap`` characters of one long line, natively."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(col) - 1, F.lit(0)), F.lit(cap))
    return F.transform(starts, lambda at: F.substring(col, at + 1, F.lit(cap)))


def merge_small(pieces: Column, floor: int = MIN_CHARS) -> Column:
    """Short pieces of an ``array<struct<heading_path,content>>`` join what follows (C4).

    A fold over the array: ``held`` is a short text that waits for the next piece. Only
    when the pieces end does it join the last one kept, or stand alone without heading.
    """
    piece = "struct<heading_path:string,content:string>"
    start = F.struct(F.array().cast(f"array<{piece}>").alias("kept"), F.lit("").alias("held"))

    def step(state: Column, p: Column) -> Column:
        body = F.when(state["held"] == "", p["content"]).otherwise(
            text.strip(F.concat(state["held"], F.lit("\n\n"), p["content"])))
        whole = F.array(F.struct(p["heading_path"].alias("heading_path"), body.alias("content")))
        return F.when(F.length(body) < floor, F.struct(state["kept"].alias("kept"), body.alias("held"))).otherwise(
            F.struct(F.concat(state["kept"], whole).alias("kept"), F.lit("").alias("held")))

    def finish(state: Column) -> Column:
        kept, held = state["kept"], state["held"]
        last = F.element_at(kept, -1)
        ending = F.array(F.struct(last["heading_path"].alias("heading_path"),
                                  F.concat_ws("\n\n", last["content"], held).alias("content")))
        alone = F.array(F.struct(F.lit("").alias("heading_path"), held.alias("content")))
        return F.when(held == "", kept).when(F.size(kept) == 0, alone).otherwise(
            F.concat(F.slice(kept, 1, F.size(kept) - 1), ending))

    return F.aggregate(pieces, start, step, finish)


def chunk_pages(pages: DataFrame, key: str = "url", content: str = "content",
                keep: Sequence[str] = (), cap: int = MAX_CHARS, floor: int = MIN_CHARS,
                overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Size-bounded, heading-tagged chunks of every page, numbered per page.

    A page stays in its row until its chunks are exploded; nothing is shuffled."""
    @F.pandas_udf("array<struct<heading_path:string,content:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            {"heading_path": path, "content": body} for path, body in packing.section_pieces(t, cap, overlap)])

    packed = pages.where(F.col(content).isNotNull()).select(key, *keep, pieces(content).alias("pieces"))
    return packed.select(
        key, *keep, F.posexplode(merge_small(F.col("pieces"), floor)).alias("chunk_index", "chunk")
    ).select(key, *keep, "chunk.heading_path", "chunk_index", "chunk.content")


def merge_small_pieces(pieces: DataFrame, key: str, order: str, floor: int = MIN_CHARS) -> DataFrame:
    """C4 on its own: ``key, order, heading_path, content`` rows -> merged chunks."""
    per_page = pieces.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, "heading_path", "content"))).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r["heading_path"].alias("heading_path"), r["content"].alias("content")))
    return per_page.select(
        key, F.posexplode(merge_small(plain, floor)).alias("chunk_index", "c")
    ).select(key, "chunk_index", "c.heading_path", "c.content")


def chunk_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Chunk count and mean size."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg(F.length(content)).alias("avg_chars"),
    )
