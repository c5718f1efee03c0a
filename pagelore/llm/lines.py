"""Repeated line runs by a suffix array over line ids, built by prefix doubling in Spark.

A line's id is its rank among the distinct repeated lines. Ranks of blocks of 1, 2, 4, …
lines come from pairs of ranks of half the length: distinct pairs are counted, range
sorted and numbered, and met again by the positions that have them. Only positions whose
block repeats go on, so each round is no larger than the last, and rounds end when no rank
repeats: every suffix is then told from every other.

Equal ranks of a round are an interval of suffixes whose common prefix has at least that
many lines. The first place of an interval stays, the others are later copies; the greatest
round in which a place is one tells how far its copy reaches at least, and the reaches of
all places together are the maximal runs to remove.

Hot lines are counted where they are read, and joins are between many positions and one row
per distinct pair or place. A rank that holds more than 1/4096 of all ranked positions comes
from a broadcast table, of fewer than 4,096 rows therefore, and its positions are dealt by
place; so no task of a join holds a larger share of one rank.

A passage kept as one long line has no second line to pair with; lines of ``long_words``
words and more are therefore taken for runs by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.tables import dropped, saved, spare

MIN_LINES = 2
#: Words from which the query and the pipeline take a single line for a passage.
LONG_WORDS = 50
#: A rank with more than this part of all ranked positions is hot.
CROWD = 4096
_PLACE = ["doc_id", "text_key", "pos"]


def _ranked(rows: DataFrame, keys: list[str], firsts: bool) -> DataFrame | None:
    """``rows`` whose ``keys`` repeat, with the order-preserving rank of the keys instead, and,
    if ``firsts``, whether a place is ``later`` than another one of its rank. None repeat: None."""
    place, more = F.struct(*_PLACE), [c for c in rows.columns if c not in (*_PLACE, *keys)]
    found = [F.count(F.lit(1)).alias("n"), *([F.min(place).alias("first")] if firsts else [])]
    names = rows.groupBy(*keys).agg(*found).where("n > 1").orderBy(*keys)
    numbered = saved(names.withColumn("name", F.monotonically_increasing_id()), "ranks")
    total = numbered.agg(F.sum("n")).first()[0]
    if total is None:
        return None
    hot = F.col("n") * CROWD > total

    def named(some: DataFrame, prefix: str) -> DataFrame:
        return some.select(*(F.col(c).alias(prefix + c) for c in some.columns if c != "n"))

    known, rest = named(numbered.where(hot), "hot_"), named(numbered.where(~hot), "all_")
    met = rows.join(F.broadcast(known), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    # a position of a hot rank looks for a negative hash of its place: it lies anywhere and meets nothing
    anywhere = [F.xxhash64(*_PLACE, F.lit(i)).bitwiseOR(F.lit(-1 << 63)) for i in range(len(keys))]
    met = met.select(
        *_PLACE, *more, "hot_name", *([(place > F.col("hot_first")).alias("hot_later")] if firsts else []),
        *(F.when(F.col("hot_name").isNull(), F.col(k)).otherwise(a).alias(k) for k, a in zip(keys, anywhere)))
    met = met.join(rest.hint("merge"), [F.col(k) == F.col(f"all_{k}") for k in keys], "left")   # it grows with the corpus
    rank = F.coalesce("hot_name", "all_name")
    later = [F.coalesce("hot_later", place > F.col("all_first")).alias("later")] if firsts else []
    ranked = saved(met.where(rank.isNotNull()).select(*_PLACE, *more, rank.alias("rank"), *later), "suffixes")
    dropped(numbered)
    return ranked


def line_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2): every line of every document with an id, by a 128-bit hash;
    with ``long_words`` also ``long``, whether it has so many words between white space."""
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lines = named.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")))
    first = F.xxhash64("col")
    long = [] if long_words is None else [
        ((F.length("col") >= 2 * long_words - 1) & (F.regexp_count("col", F.lit(r"\S+")) >= long_words)).alias("long")]
    return lines.select(*_PLACE, first.alias("h1"), F.xxhash64(F.lit(7), F.reverse("col"), first).alias("h2"), *long)


def _rounds(docs: DataFrame, doc_id: str, text: str, min_lines: int, long_words: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(span, ranks) of every round, that of single lines first."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    now, span = _ranked(line_places(docs, doc_id, text, long_words), ["h1", "h2"], min_lines == 1), 1
    while now is not None:
        yield span, now
        step = span if span >= min_lines else min(span, min_lines - span)
        now = now.select(*_PLACE, "rank")
        # repeated rows have the same places, each of which must be met once only
        after = now.select("doc_id", "text_key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next")).dropDuplicates(_PLACE)
        now, span = _ranked(now.join(after, _PLACE), ["rank", "next"], span + step >= min_lines), span + step


def suffix_ranks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_lines: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """For spans of ``min_lines`` lines and twice, four times, … as many, until none repeats: the span
    and (doc_id, text_key, pos, rank, later) of the places where a run of so many lines begins that
    begins elsewhere too. Equal ranks are equal runs, and ranks follow the suffix order."""
    return ((span, ranks) for span, ranks in _rounds(docs, doc_id, text, min_lines) if span >= min_lines)


def later_copies(copies: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the maximal line intervals made of (doc_id, text_key, pos, stop) runs."""
    later = copies.groupBy(*_PLACE).agg(F.max("stop").alias("stop"))
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    before = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("fresh", (F.col("pos") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("island", F.sum("fresh").over(by_doc))
    spans = islands.groupBy("doc_id", "text_key", "island").agg(F.min("pos").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                   long_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, spans): the maximal line intervals that stand earlier too, written as a table."""
    tables, copies = [], []
    for span, ranks in _rounds(docs, doc_id, text, min_lines, long_words):
        tables.append(ranks)
        if span >= min_lines:
            copies.append(ranks.where("later").select(*_PLACE, (F.col("pos") + span).alias("stop")))
        elif span == 1 and long_words is not None:
            long = _ranked(ranks.where("long").select(*_PLACE, "rank"), ["rank"], True)
            if long is not None:
                tables.append(long)
                copies.append(long.where("later").select(*_PLACE, (F.col("pos") + 1).alias("stop")))
    if not copies:
        copies = [line_places(docs, doc_id, text).select(*_PLACE, F.col("pos").alias("stop")).where("false")]
    spans = saved(later_copies(reduce(DataFrame.unionByName, copies)), "spans")
    dropped(*tables)
    return spans


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                          to: str = "text", spans: str = "removed_spans", lines: str | None = "n_lines",
                          long_words: int | None = None) -> DataFrame:
    """``docs`` with the text left in ``to``, its line count and the removed line intervals.

    Lines end at a line feed. A line goes when a run of ``min_lines`` lines over it begins
    earlier too, in a smaller id or above in the same text; the first copy stays. With
    ``long_words``, a single line of that many words goes by itself in the same way. An empty
    text is one empty line; a null text stays null with no lines; rows without an id stay
    whole and count for no other; repeated rows get the same result. If ``docs`` has a column
    ``spans`` or ``lines`` already, it stays and the new one gets underscores at its end.
    """
    spans, lines = spare(docs, spans), lines and spare(docs, lines)
    id_, key = spare(docs, "doc_id_"), spare(docs, "text_key")
    copies = repeated_spans(docs, doc_id, text, min_lines, long_words).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spare(docs, "found")))
    found = spare(docs, "found")
    met = docs.withColumns({id_: F.col(doc_id), key: F.xxhash64(F.col(text))}).join(copies.hint("merge"), [id_, key], "left")
    all_lines, cut = F.split(F.col(text), "\n"), F.col(found)

    def kept(i):
        start = F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["stop"])
        stop = F.coalesce(F.get(cut, i)["start"], F.size(all_lines))
        return F.slice(all_lines, start + 1, stop - start)

    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), kept)), "\n")
    columns = {to: F.when(cut.isNull(), F.col(text)).otherwise(rest),
               spans: F.coalesce(cut, F.array().cast("array<struct<start:int,stop:int>>"))}
    if lines:
        columns[lines] = F.coalesce(F.size(all_lines), F.lit(0))
    return met.withColumns(columns).drop(id_, key, found)
