"""Texts that would take a careless pattern or table quadratic time or memory."""

import time

import pyarrow as pa
import pytest

from jikjo.functions.codepoints import slices
from jikjo.llm import contamination, mojibake, neardup, quality, sentences, splitting

N = 100_000
TEXTS = {
    "dots": "." * N + "a",
    "marks": "!" * N + "가",
    "jamo": "했다" + "ㅋ" * N + "가",
    "open": "f(" * (N // 2),
    "tags": "<a " * (N // 3),
    "spaces": " " * N + "x",
    "breaks": "\n" * N,
    "quotes": "“" * N,
    "leaders": "...." * (N // 8) + " 12 x",
    "questions": "? " * (N // 2),
    "letters": "Ã©" * (N // 2),
}


@pytest.fixture(scope="module")
def weights():
    return mojibake.train(["한글 문장이다. 그는 도서관을 갔다.", "Le théâtre est fermé.", "他们从海南村带回船只。"] * 30)


@pytest.mark.parametrize("name", TEXTS)
def test_in_linear_time(name, weights):
    x = TEXTS[name]
    began = time.process_time()
    assert all(0 <= a < b <= len(x) for a, b in sentences.direct(x))
    assert splitting.plan(x)[-1][1] == len(x)
    rows = quality.split(x)
    assert sum(quality.look(rows, [3.0] * len(rows)).chars) <= len(x)
    mojibake.repair(weights, x)
    list(contamination._post(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([x])], ["row_id", "text"])])))
    neardup._shingled([x], 5, 0, False)
    assert time.process_time() - began < 20


def test_batches_are_cut_by_their_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c", "d" * 3])], ["t"])
    parts = [p.column(0).to_pylist() for p in slices(b, 0, 60)]
    assert [x for p in parts for x in p] == b.column(0).to_pylist() and len(parts) > 1
    assert list(slices(b.slice(0, 0), 0)) == []
