import re

import corpus_pipeline
import pytest
from tests.llm.test_shingle_dedup import brute
from veriframe.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_passages(texts, words=51):
    """(id, passage) for runs of words that stand in another text of different content, too."""
    places = {}
    for d, text in texts.items():
        found = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        for i in range(len(found) - words + 1):
            places.setdefault((text or "")[found[i][0]:found[i + words - 1][1]], set()).add(d)
    return [(d, p) for p, where in places.items() if len({texts[d] for d in where}) > 1 for d in where]


def test_stages(spark, small, tmp_path):
    docs = queries.table(spark, small, "documents")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            continue
        assert out.columns == names
        after = {r.doc_id: r.text for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "simhash_dedup":
            # the stage's rule: five-word shingles, a Jaccard similarity of 0.8 or more, all pairs compared
            assert sorted(after) == [d for _, d in brute(list(before.items()))]
        if name == "suffix_dedup":
            assert all(len(after[d]) <= len(before[d]) for d in after if before[d])
            passages = repeated_passages(before)
            gone = [p not in (after.get(d) or "") for d, p in passages]
            assert sum(gone) >= 0.95 * len(gone)
        if name == "decontamination":
            items = [r.text for r in queries.table(spark, small, "benchmark").collect()]
            assert not any(i in (t or "") for t in after.values() for i in items)
            assert all(after[d] == before[d] for d in after)
        before, docs = after, out


def test_edges(spark, small):
    rows = [(None, "a b c", "en", "s", 5), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0),
            (3, "word " * 4000, "en", "s", 20000), (4, "word " * 4000, "en", "s", 20000), (5, "Ein kurzer Text", "de", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, small)
            assert (out.count() == 0) == (part.count() == 0)
            if name != "packing":
                assert out.schema.simpleString() == docs.schema.simpleString()


# Names that stages and operators use for themselves.
NAMES = ("score difference _row _key kept n_removed n_bytes n_spans _spans _body _edges c0 c1 label key gram whole node root digest "
         "keys first seg all _salt _often text_ doc")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "packing"])
def test_columns_of_any_name_pass_through(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = queries.table(spark, small, "documents").where("doc_id < 60")
    plain = {r.doc_id: r.text for r in stage(spark, docs, small).collect()}
    extra = NAMES.split()
    more = docs.selectExpr("n_chars", "text", *[f"concat('{c}-', doc_id) AS `{c}`" for c in extra], "doc_id", "lang AS `a b.c`")
    rows = stage(spark, more, small)
    assert rows.columns == more.columns
    found = rows.collect()
    assert {r.doc_id: r.text for r in found} == plain and len(found) == len(plain) > 0
    assert all(r[c] == f"{c}-{r.doc_id}" for r in found for c in extra)
