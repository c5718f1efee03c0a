"""Pure helpers: packing, stemming, and text column expressions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.functions import packing, text
from pagelore.functions.stemming import stem
from pagelore.operators import chunking


def test_short_section_is_one_piece():
    assert packing.pack_section("x" * 1200) == ["x" * 1200]


def test_one_char_over_the_cap_without_breaks_is_sliced():
    assert [len(p) for p in packing.pack_section("x" * 1201)] == [1200, 203]   # overlap, blank line, rest


def test_paragraphs_carry_the_tail_of_the_last_one():
    first, second = "a" * 700, "b" * 700
    assert packing.pack_section(f"{first}\n\n{second}") == [first, "a" * 200 + "\n\n" + second]


def test_blank_lines_between_paragraphs_are_not_counted():
    text_ = "\n\n".join(["a" * 600, "b" * 600, "c" * 10])
    assert packing.pack_section(text_)[0] == "a" * 600 + "\n\n" + "b" * 600


def test_line_over_the_cap_is_sliced_between_lines():
    lines = list(packing.split_lines("\n".join(["a" * 10, "b" * 2500, "c" * 10])))
    assert [len(p) for p in lines] == [10, 1200, 1200, 100, 10]


def test_lines_count_their_break():
    # 600 + 1 + 599 = 1200 fits, one more does not
    assert len(list(packing.split_lines("a" * 600 + "\n" + "b" * 599))) == 1
    assert len(list(packing.split_lines("a" * 600 + "\n" + "b" * 600))) == 2


def merged(spark, pages, floor=200):
    """C4 over several pages of pieces at once."""
    rows = spark.createDataFrame([(i, page) for i, page in enumerate(pages)],
                                 "page int, pieces array<struct<heading_path:string,content:string>>")
    out = rows.select("page", chunking.merge_small(F.col("pieces"), floor).alias("chunks")).orderBy("page").collect()
    return [[(c["heading_path"], c["content"]) for c in r["chunks"]] for r in out]


def test_small_pieces_join_their_neighbours(spark):
    long = "y" * 200
    assert merged(spark, [
        [("A", "x"), ("B", long), ("C", "z")], [("A", "x"), ("B", "y")], [], [("A", ""), ("B", "")], [("A", long), ("B", long + "y")],
        [("A", ""), ("B", " x ")], [("A", "x"), ("B", " "), ("C", long)],
    ]) == [[("B", f"x\n\n{long}\n\nz")], [("", "x\n\ny")], [], [], [("A", long), ("B", long + "y")], [("", " x ")], [("C", f"x\n\n{long}")]]


paragraph = st.text(alphabet="ab \n", min_size=1, max_size=400).map(str.strip).filter(bool)


@settings(max_examples=150, deadline=None)
@given(st.lists(paragraph, min_size=1, max_size=12), st.integers(20, 120))
def test_every_line_survives_in_order(paragraphs, cap):
    source = "\n\n".join(paragraphs)
    pieces = packing.pack_section(source, cap, overlap=0)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(pieces)) == squeeze(source)


def test_only_a_short_page_gives_a_short_chunk(spark):
    rng = random.Random(4)
    pages = [[("h", "a" * rng.randint(1, 60)) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    for page, chunks in zip(pages, merged(spark, pages, 30)):
        assert len(chunks) == 1 or all(len(body) >= 30 for _, body in chunks)
        assert "".join(b for _, b in chunks).replace("\n", "") == "".join(b for _, b in page)


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat",
             "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "operator": "oper",
             "formalize": "formal", "electrical": "electr", "hopefulness": "hope", "adjustment": "adjust",
             "adoption": "adopt", "probate": "probat", "controlling": "control", "sky": "sky", "sing": "sing"}
    assert {w: stem(w) for w in known} == known


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()[0]


def test_redaction(spark):
    dirty = " my sk_test_abc1 and rk_live_Z9 and whsec_77 but not sk_other_1  "
    assert one(spark, text.redact_secrets(F.col("q")), q=dirty) == (
        "my [redacted key] and [redacted key] and [redacted key] but not sk_other_1")


def test_code_needs_a_fence(spark):
    assert one(spark, text.has_code(F.col("a")), a="1. do\n   ```js\n   x\n   ```")
    assert not one(spark, text.has_code(F.col("a")), a="use `x` and ``` inline")
    assert one(spark, text.retitle_without_code(F.col("a")), a="**Code sample** `x`") == "**Steps** `x`"


def test_snapshot_path(spark):
    path = text.snapshot_path(F.col("u"))
    assert one(spark, path, u="https://d.example.com/payments/checkout.md") == "pages/payments/checkout.md"
    assert one(spark, path, u="https://d.example.com/accept.md?platform=web&x=1") == "pages/accept__platform=web_x=1.md"


def test_embed_input_skips_missing_parts(spark):
    rows = spark.createDataFrame(
        [("T", "H", "c"), ("T", None, "c"), ("", "H", "c"), (None, "", "c")], "t string, h string, c string")
    got = [r[0] for r in rows.select(text.embed_input(F.col("t"), F.col("h"), F.col("c"))).collect()]
    assert got == ["T — H\n\nc", "T\n\nc", "H\n\nc", "c"]


def test_row_hash_cannot_be_spelled_two_ways(spark):
    rows = spark.createDataFrame([("a;1:b", None), ("a", "b"), (None, "a;1:b"), ("", "~")], "x string, y string")
    assert rows.select(text.row_hash("x", "y").alias("h")).distinct().count() == 4
