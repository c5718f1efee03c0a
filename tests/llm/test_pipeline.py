"""The corpus pipeline against what each stage must do to planted documents."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pagelore.llm.queries import TOKENIZERS
from tests.llm.conftest import DOCS, awkward_rows, prose


@pytest.fixture(scope="module")
def folder(ready, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    passage = prose(900, 40)
    clean = {i: prose(i, 60) + "\n" + prose(1000 + i, 40) for i in range(60)}
    toxic = {100 + i: prose(2000 + i, 30) + " you scum idiot " + prose(3000 + i, 30) for i in range(60)}
    planted = {200: clean[3], 201: clean[5] + " end", 202: prose(5000, 20) + " " + passage, 203: None, 204: "", 205: None,
               206: "same first line here\nand the second\n" + prose(6000, 30), 207: prose(6001, 30) + "\nsame first line here\nand the second"}
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in (clean | toxic | planted).items()]
    ready.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in clean] + [(i, 1, 1) for i in toxic]
    ready.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    ready.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, clean | planted


def test_planted_documents(ready, folder):
    path, texts = folder
    library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    got = {r["doc_id"]: r for r in cp.run(ready, path).collect()}
    # toxic ones, near copies, the benchmark passage and all but one empty text are gone; 200
    # is the first empty one, as both its lines are a later copy of 3; 201 keeps the line of its own
    assert set(got) == set(range(60)) | {200, 201, 206, 207}
    left = dict(texts) | {200: "", 201: texts[201].split("\n")[1]}
    left[207] = texts[207].split("\n")[0]   # the run of two lines stays in 206 only
    for doc, row in got.items():
        wanted = library.encode(left[doc] or "", add_special_tokens=False).ids
        assert row["ids"] == np.array(wanted, "<u4").tobytes() and row["n_tokens"] == len(wanted)
        decoded = library.decode(wanted, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert row["n_chars"] == (None if left[doc] is None else len(left[doc]))


def test_every_stage_takes_awkward_and_empty_tables(ready, folder):
    path, _ = folder
    for rows in (awkward_rows(), []):
        docs = ready.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as hit_spans", "3 as n_lines", "4 as text_key", "5 as ids")
        for name, stage in cp.STAGES:
            out = stage(ready, docs, path)
            assert name == "bpe" or out.columns == docs.columns, name
            assert out.count() <= docs.count() and ("bpe" == name or out.select("ids").distinct().count() <= 1)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"] and cp.ORACLE_SQL is None
