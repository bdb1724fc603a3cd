import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weft.llm.common import SpanHashes, slices, utf8, words

TEXTS = [None, "", " ", "a", "a b", "\n\n", " é x ", "end", "of", "日本 語", "a\x0bb\x0cc"]


def test_words_match_the_pattern_across_text_borders():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab é\n\t ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    raw, at = utf8(pa.array(texts))
    starts, ends, doc = words(raw, at)
    got = [[] for _ in texts]
    for s, e, d in zip(starts, ends, doc):
        got[d].append(raw[s:e].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_utf8_of_a_slice_and_of_nothing():
    raw, at = utf8(pa.array(["xx", "yy", None, "z"]).slice(1, 3))
    assert raw.tobytes() == b"yyz" and at.tolist() == [0, 2, 2, 3]
    raw, at = utf8(pa.array([], pa.string()))
    assert len(raw) == 0 and at.tolist() == [0]


def test_slices_keep_all_rows_and_long_texts_alone():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, "b", None, "c" * 50, "d"]})
    parts = [p.column("t").to_pylist() for p in slices([batch], "t", 12)]
    assert sum(parts, []) == ["a" * 10, "b", None, "c" * 50, "d"] and ["c" * 50] in parts


def test_equal_spans_hash_alike():
    raw = np.frombuffer(b"abcabxabc", np.uint8)
    h = SpanHashes(raw).of(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[2] != h[1]


def test_shared_folder_is_required_on_a_cluster():
    from weft.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_dir(Fake())
