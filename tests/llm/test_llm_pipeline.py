"""The pipeline's stages, each against what it was given."""

import re

import pytest

import corpus_pipeline
from pelagia.llm import decontaminate
from pelagia.llm.queries import ORACLE, QUERIES
from pelagia.llm.tables import stored, table
from tests.conftest import SMALL

duckdb = pytest.importorskip("duckdb")


def test_stages_filter_in_turn(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        assert out.exceptAll(docs).isEmpty()
        kept.append(out)
        docs = out
    good, exact, near, clean = kept
    assert exact.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in good.collect()}) == exact.count()

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {r.doc_id: shingles(r.text) for r in exact.collect()}
    left = {r.doc_id for r in near.collect()}
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert not any(a < b and like(sets[a], sets[b]) for a in left for b in left)
    assert all(any(d != e and like(sets[d], sets[e]) for e in sets) for d in sets.keys() - left)
    bench = table(spark, SMALL, "benchmark")
    assert decontaminate.contamination(near, bench).where("size(starts) = 0").count() == clean.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, clean, SMALL)
    assert packed.select("doc_id").distinct().count() == clean.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    wanted = connection.sql(ORACLE[name]).to_arrow_table()
    found = QUERIES[name](spark, SMALL).toArrow()
    rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)]), key=repr)
    assert rows(found) == rows(wanted)
    assert {f.name: str(f.type).replace("large_", "") for f in found.schema} == {f.name: str(f.type).replace("large_", "") for f in wanted.schema}
