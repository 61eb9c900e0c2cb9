"""Requests that are refused, and sections of knowledge documents by their properties."""

import random
import re

import pytest

from opsframe.operators import documents
from opsframe.operators.select import LogRequest

GOOD = {"start": 0, "end": 10}


@pytest.mark.parametrize(("wrong", "says"), [
    ({"start": 10}, "before end"), ({"start": 11}, "before end"), ({"end": 30 * 86_400_000_000 + 1}, "30 days"), ({"include": ["a"] * 21}, "more than 20"), ({"include": ["a"] * 11, "exclude": ["b"] * 10}, "more than 20"),
    ({"filters": [("level", "eq", ["x"])] * 21}, "more than 20"), ({"limit": 0}, "1 to 1000"), ({"limit": 1001}, "1 to 1000"), ({"mode": "regex"}, "unknown keyword mode"),
])
def test_log_requests_out_of_bounds(wrong, says):
    with pytest.raises(ValueError, match=says):
        LogRequest(**(GOOD | wrong)).validate()


@pytest.mark.parametrize("edge", [{}, {"end": 30 * 86_400_000_000}, {"include": ["a"] * 20}, {"filters": [("level", "eq", ["x"])] * 20}, {"limit": 1}, {"limit": 1000}, {"mode": "phrase"}])
def test_log_requests_at_their_bounds(edge):
    request = LogRequest(**(GOOD | edge))
    assert request.validate() is request


def headings(text):
    """Every heading with its path, from the lines alone."""
    path, out = [], [""]
    for line in text.split("\n"):
        m = re.match(r"(#{1,6}) (.*)", line)
        if m:
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            out.append(" > ".join(path))
    return out


def test_sections_of_markdown(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["# Top", "## Part " + "ab"[rng.randrange(2)], "### Deep", "#no heading", "", "words and more. " * rng.randint(1, 30), "x" * rng.randint(1, 4000), "ßé. " * 40])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "# only a heading", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {}
    for r in documents.split_markdown(rows).collect():
        by.setdefault(r["doc_id"], []).append(r)
    bare = lambda t: re.sub(r"[\s.]+", "", t)  # noqa: E731  what cuts may take away
    for i, text in enumerate(texts):
        own = sorted(by.get(i, []), key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        assert all(0 < len(r["content"]) <= documents.CHUNK for r in own)
        body = "\n".join(x for x in (text or "").split("\n") if not re.match(r"#{1,6} ", x))
        assert bare("".join(r["content"] for r in own)) == bare(body)
        known = headings(text or "")
        places = [known.index(r["heading"]) for r in own]
        assert len(set(known)) < len(known) or places == sorted(places)
