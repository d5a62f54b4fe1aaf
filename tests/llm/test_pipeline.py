"""The corpus pipeline against plain versions of its stages."""

import re
from collections import defaultdict

import corpus_pipeline as P
from panelforge.llm import queries as Q
from panelforge.llm.mixing import mix_counts

from .test_operators import brute_components, library

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows, texts = docs.columns, None, {}
    assert [n for n, _ in P.STAGES][0] == "language ID" and len(P.STAGES) == 5
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "language ID":
            assert ids >= {i for i, r in before.items() if re.search("[a-z]{3}", r.text or "")}
        elif name == "exact dedup":
            groups = defaultdict(list)
            for i, r in before.items():
                groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), i))
            assert ids == {min(g)[1] for g in groups.values()}
        elif name == "n-gram Jaccard join":
            assert ids == {i for i, (_, c) in brute_components([(i, r.text) for i, r in before.items()]).items() if i == c}
        elif name == "mixing":
            want = {r.doc_id: r.taken for r in mix_counts(spark.read.parquet(f"{tmp_path}/{k - 1}")).collect() if r.taken}
            assert {r.doc_id: len(r.text.split(" ")) for r in rows} == want
            texts = {r.doc_id: r.text for r in rows}
        else:
            sp = library()
            assert all(r.ids == [*sp.encode(texts[r.doc_id]), sp.eos_id()] and r.n_tokens == len(r.ids) for r in rows)
    whole = {r.doc_id: r.ids for r in P.run(spark, SMALL).collect()}
    assert whole == {r.doc_id: r.ids for r in rows}
    assert Q.QUERIES and P.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, group_size int, `a.b` string, _row string"


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and further columns of clashing names."""
    body = next(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' AND n_chars > 2000").collect())
    rows = [(1, body, "en", "s", 5), (1, body, "en", "s", 5), (2, body + " ", None, None, None), (3, None, "en", "s", 1), (4, "", "en", "s", 0), (5, "12 34", "fr", "t", 5), (None, body + " more words at the end", "en", "s", 1)]
    rows += [(6, " ".join([body] * 30), "en", "u", 9), (7, "word", "en", None, 4)]
    docs = spark.createDataFrame([(*r, "k", "0.5", 7, "dot", "row") for r in rows], ODD)
    expected = [{1, 2, 6, 7, None}, {2, 6, 7, None}, {2, 7, None}, None]  # 6 repeats 2, so its set of shingles is nearly the same
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        assert all((r.kept, r.score, r.group_size, r["a.b"], r["_row"]) == ("k", "0.5", 7, "dot", "row") for r in got)
        if expected[k] is not None:
            assert {r.doc_id for r in got} == expected[k]
    last = P.pieces(spark, docs, SMALL)
    assert last.count() == docs.count() and P.pieces(spark, docs.limit(0), SMALL).count() == 0
