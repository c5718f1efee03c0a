import random
import re

import pytest

from pagelore.llm import licenses
from pagelore.llm.licenses import PHRASES, TEMPLATES, as_pattern, parse, scan, words_of
from tests.llm.conftest import awkward_rows


def brute(text, templates=TEMPLATES):
    """Phrase places by lists, template labels by regular expressions over the words."""
    words = words_of(text or "")
    base = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(words_of(p))] == words_of(p))
    line = "".join(" " + w for w in words)
    return len(words), base, {label for label, t in templates.items() if re.search(as_pattern(parse(t)) + "(?= |$)", line)}


def shape(row):
    return (row["n_words"], sorted((s["start"], s["label"]) for s in row["phrases"]), {s["label"] for s in row["templates"]})


def wording(markup, full, rng):
    text = markup if full else re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", markup, flags=re.S)
    text = re.sub("<<(begin|end)Optional>>", "", text)
    return re.sub(r'<<var;match="\.\{(\d+),(\d+)\}">>', lambda m: " w" * rng.randint(int(m[1]), int(m[2])), text)


def test_templates_with_and_without_their_regions(ready):
    rng = random.Random(1)
    texts = [f"{before} {wording(t, full, rng).upper()} {after}" for t in TEMPLATES.values() for full in (True, False)
             for before, after in (("", ""), ("x", "y"), (wording(t, True, rng), "licensed under"))]
    texts += [t.replace("the", "a", 1) for t in texts[:30]] + [" ".join(w for w in t.split() if rng.random() < 0.97) for t in texts]
    rows = scan(ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        assert shape(row["license_scan"]) == brute(row["text"]), row["text"]
    found = {label for row in rows for label in shape(row["license_scan"])[2]}
    assert found == set(TEMPLATES)


def test_random_templates_against_patterns(ready):
    rng = random.Random(2)

    def markup(depth=0):
        parts = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.6 or depth == 2:
                parts.append(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))))
            elif kind < 0.8:
                parts.append(f"<<beginOptional>>{markup(depth + 1)}<<endOptional>>")
            else:
                low = rng.randint(0, 2)
                parts.append(f'<<var;match=".{{{low},{low + rng.randint(0, 3)}}}">>')
        return " ".join(parts)

    templates = {f"t{i}": "a " + markup() for i in range(25)}
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    out = scan(ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()
    for row in out:
        assert shape(row["license_scan"]) == brute(row["text"], templates)
        for span in row["license_scan"]["templates"]:
            part = "".join(" " + w for w in words_of(row["text"])[span["start"]:span["stop"]])
            assert re.fullmatch(as_pattern(parse(templates[span["label"]])), part)


def test_awkward_rows_and_clashing_names(awkward, empty):
    more = "the Apache License cc by cc by-nc 4.0 MIT license; gnu general public licenses"
    frame = awkward.selectExpr("doc_id", f"concat(text, ' {more}') AS text", "lang AS license_scan", "1 AS made", "2 AS n_words")
    rows = scan(frame).collect()
    assert len(rows) == len(awkward_rows())
    for row in rows:
        assert shape(row["license_scan"]) == brute(row["text"]) and row["n_words"] == 2 and row["made"] == 1
    assert scan(empty).count() == 0


@pytest.mark.parametrize("markup", ["a <<beginOptional>> b", "a <<endOptional>>", "a <<var;match=\"x\">>", "<<beginOptional>>a<<endOptional>>", ""])
def test_faulty_templates_are_refused(empty, markup):
    with pytest.raises(ValueError):
        scan(empty, templates={"x": markup})
    assert licenses.parse("a")
