import corpus_pipeline
from pairloom.llm import exact, quality, similar
from tests.llm.conftest import ODD
from tests.llm.test_packing import PATH, plain, whole
from tests.llm.test_pii import plain as base_spans
from tests.llm.test_quality import plain as counts
from tests.llm.test_similar import plain_kept


def test_stages_on_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        docs = stage(spark, docs, sf)
    assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() >= len(ODD)


def test_stages_on_an_empty_table(spark, empty, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run_is_what_plain_code_gives(spark, sf, rows, documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    cutoffs = quality.learn(quality.measure(documents), spark.read.parquet(f"{sf}/labels.parquet"))
    assert all(c.rule in quality.RULES for c in cutoffs)
    text = {}
    for i, t in rows:
        n, chars, symbols, dup, repeat = counts(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            share = symbols / chars
            if not any(c.stratum == langs[i] and c.rule == "symbol_share" and share > c.cutoff for c in cutoffs):
                text[i] = t
    last = {}
    for i, t in text.items():
        last[t] = max(i, last.get(t, -1))
    text = {i: t for t, i in last.items()}
    text = {i: text[i] for i in plain_kept(list(text.items()))}

    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == set(text)
    whole(found, 4096)
    clean = [(i, t) for i, t in text.items() if not base_spans(t)]
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found if r.doc_id in dict(clean)), key=repr)
    assert got == plain(clean, 4096)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    assert exact and similar
