"""The filter audit against one document and order at a time."""

import itertools
import re

import numpy as np
import pytest

from affinade.llm.filter_audit import FILTERS, KEPT, ORDERS, Sums, audit, first_failures, partial_sums

DOCS = "doc_id long, text string, lang string, part string, fails int, digest string, first boolean"
LABELS = "doc_id long, quality int, toxic int, good boolean"


def brute(docs, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for d, text, *_ in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        f["E"] = d is not None and any(o is not None and o < d and (t or "") == text for o, t, *_ in docs)
        fails.append({k for k, v in f.items() if v})
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = [(f, d[0] in good, d[0] in toxic) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in map("".join, itertools.permutations(FILTERS)):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                shapley[c] += len(gone)
                failing = sum(c in x[0] for x in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def table_of(rows):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}


def test_lookup_table_says_which_step_removes():
    table = first_failures()
    assert table.shape == (32, 120) and (table[0] == KEPT).all()
    for mask, o in itertools.product(range(32), range(120)):
        steps = [k for k, c in enumerate(ORDERS[o]) if mask >> FILTERS.index(c) & 1]
        assert table[mask, o] == (steps[0] if steps else KEPT)


def test_audit_equals_brute_force_on_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, words, "en"), (2, words, "en"), (3, words, "de"), (3, words, "de"), (4, words + " #", "en"), (5, None, None), (6, "", ""), (7, None, "en"),
        (None, words, "en"), (None, None, None), (8, "A B C", "en"), (9, "x " * 300, "de"), (10, words + "\x85\xa0　x\x0b", "fr"), (11, "a\n" * 200_000, "fr"),
        (12, "ÄÖ" * 60 + "Q" * 12, "fr"), (13, words.upper(), "de"), (-5, words.upper(), "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (8, 0, 1), (8, 0, None), (13, 1, 1), (99, 1, 1), (None, 1, 1), (9, 2, 7)]
    df = spark.createDataFrame([(*d, "p", 3, "d", True) for d in docs], DOCS)
    got = table_of(audit(df, spark.createDataFrame([(*x, True) for x in labels], LABELS)).collect())
    want = brute(docs, labels)
    assert set(got) == set(want) and len(got) == 4 * 600
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_audit_does_not_depend_on_partitions(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"{'W' if rng.random() < 0.3 else 'w'}{k if rng.random() < 0.8 else 0}" for k in range(rng.integers(60, 160))) + ("#" if rng.random() < 0.3 else "") for _ in range(12)]
    docs = [(int(rng.integers(0, 60)), texts[int(rng.integers(12))], ["en", "de", None][int(rng.integers(3))]) for _ in range(60)]
    labels = [(k, int(rng.integers(2)), int(rng.integers(2))) for k in range(0, 60, 2)]
    df = spark.createDataFrame([(*d, "p", 3, "d", True) for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, True) for x in labels], LABELS)
    want = brute(docs, labels)
    for n in (1, 7):
        assert table_of(audit(df.repartition(n), marks).collect()) == want


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "p", 3, "d", True)], DOCS)
    assert table_of(audit(one, labels).collect()) == brute([(1, "x", "en")], [])


def test_many_parts_leave_a_task_in_bounded_sums():
    import pyarrow as pa

    n = 1000
    rows = pa.RecordBatch.from_pydict({"part": [f"p{k % 700}" for k in range(n)], "fails": [k % 32 for k in range(n)], "good": [k % 2 == 0 for k in range(n)], "toxic": [k % 3 == 0 for k in range(n)]})
    out = list(partial_sums(iter([rows, rows])))
    assert max(b.num_rows for b in out) <= 512
    total = sum(int(np.array(v.as_py()).sum()) for b in out for v in b.column("masks"))
    lost = sum(int(np.array(v.as_py())[: Sums.WIDTH].sum()) for b in out for v in b.column("lost"))
    assert total == 2 * n and lost == 2 * n * 120
