"""Columns passed through, and vectors whose ids repeat."""

import numpy as np
import pytest

from popatlas.llm import common, embedding_dedup, exact_dedup, similar_texts
from popatlas.plans import storage

NAMES = "_id _sha _key _gone _gone_key _gone_sha _twice _T label component".split()


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, similar_texts.drop_similar])
def test_clashing_columns_are_passed_through(spark, drop):
    words = " ".join(f"w{i}" for i in range(40))
    data = [(1, words), (2, words), (3, "another text of a few more words"), (3, "another text of a few more words"), (None, None)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in data], schema)
    got = drop(df)
    assert got.dtypes == df.dtypes
    found = {r.doc_id: tuple(r)[2:] for r in got.collect()}
    assert found == {i: tuple(f"{n}{i}" for n in NAMES) for i in found}
    assert len(found) == 3 and 3 in found and None in found


def test_numbered_rows_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: None)
    monkeypatch.setattr(storage, "shared_folder", lambda _: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.number_rows(spark.range(3), ["id"], "t", "at")


def linked(a, b):
    (_, la, va), (_, lb, vb) = a, b
    if la is None or la != lb or va is None or vb is None or len(va) != len(vb):
        return False
    x, y = np.array(va), np.array(vb)
    if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
        return False
    return va == vb or x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98


def test_vectors_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(2)
    base = [rng.normal(size=16) for _ in range(4)]
    data = []
    for i in range(60):
        vector = base[i % 4] + rng.normal(size=16) * (0.05 if i % 3 else 0.25)
        name = None if i % 11 == 5 else i % 23
        data.append((name, "ab"[i % 7 % 2] if i % 13 else None, vector.tolist()))
    data += [data[3], data[3], (3, "b", data[3][2]), (None, "a", data[7][2]), (99, "a", [0.0] * 16), (98, "a", None)]
    near = [[j for j in range(len(data)) if j != i and linked(data[i], data[j])] for i in range(len(data))]
    want = []
    for i, (name, *_) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        smallest = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        want.append((name, len(near[i]), smallest, name == smallest))
    assert max(n for _, n, *_ in want) > 5
    df = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>").repartition(4)
    got = map(tuple, embedding_dedup.similar_vectors(df).collect())
    assert sorted(got, key=str) == sorted(want, key=str)


def test_recall_of_planted_pairs_at_the_threshold():
    """1,000 pairs at a cosine of just 0.98 share a table nearly always."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    width, k, tables = embedding_dedup.shape(2000, 0.98)
    planes, shift = rng.normal(size=(64, tables * k)), rng.uniform(0, width, tables * k)
    cells = [np.floor((x @ planes + shift) / width).reshape(-1, tables, k) for x in (a, b)]
    found = (cells[0] == cells[1]).all(axis=2).any(axis=1)
    assert found.mean() >= 0.999
