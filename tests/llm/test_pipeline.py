import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_duplicates import brute as classes
from tests.llm.test_secrets import base, weak

SF = "/root/testdata/sf0.001"


def redacted(text):
    a, b, c = base(text)
    out, at = "", 0
    for s, e in sorted({*a, *b, *c, *((s, e) for s, e, _ in weak(text))}):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        seen.append(docs.collect())
    start, language, distinct, clean, safe, packed = seen
    key = lambda rows: sorted(r.doc_id for r in rows)
    lang = {r.doc_id: r.lang for r in start}
    english = {d for d, v in lang.items() if v == "en"}
    assert len({r.doc_id for r in language} & english) >= 0.99 * len(english)
    others = [r for r in start if r.lang not in ("en", None)]
    assert others and len({r.doc_id for r in language} & {r.doc_id for r in others}) < 0.1 * len(others)
    first = {c for _, c, _ in classes([(r.doc_id, r.text) for r in language])}
    assert set(key(distinct)) == first and len(distinct) == len(first)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    hit = {d for d, *_, bad in contaminated([(r.doc_id, r.text) for r in distinct], items) if bad}
    assert key(clean) == sorted(set(key(distinct)) - hit) and hit
    assert key(safe) == key(clean)
    was = {r.doc_id: r for r in clean}
    for r in safe:
        assert r.text == redacted(was[r.doc_id].text)
        assert r.n_chars == (len(r.text) if r.text != was[r.doc_id].text else was[r.doc_id].n_chars)
    assert {r.doc_id for r in packed} == set(key(safe))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 100


EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _row int, hit_words string, kind int, weak string, node long, piece int"


def test_stages_on_edge_rows(spark, tmp_path):
    more = (0.5, "x", 1, "y", 2, "z", 3, 4)
    same = "the same words stand here twice and then once more, so it goes"
    rows = [(1, same, "en", "a", 1, *more), (1, same, "en", "a", 1, *more), (2, same, None, None, None, *more), (None, "a text without an id, but with enough words in it", "en", None, 1, *(None,) * 8), (3, None, "en", "a", 0, *more), (4, "", "de", "a", 0, *more), (5, "12 %% 34", "de", "a", 0, *more), (6, "long " * 30_000 + "password=abcdefghijklmnop end", "en", "a", 1, *more)]
    docs = spark.createDataFrame(rows, EDGE)
    columns, sizes = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.select("doc_id").distinct().count())
        if k < 4:
            assert docs.columns == columns
    assert sizes == [4, 3, 3, 3, 3]  # ids 1, 2, none, 6; then 1, none, 6


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
