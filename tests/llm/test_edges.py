"""Every operator and stage on odd rows, empty tables and clashing columns."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from sqltally.llm import alignment, bpe, collocations, hamming, jaccard, licenses, lines, neardup, packing, quality, secrets, spotsigs, toxicity

QUERIES = {
    "licenses": lambda d, l: licenses.query(d),
    "secrets": lambda d, l: secrets.query(d),
    "bpe": lambda d, l: bpe.query(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "lines": lambda d, l: lines.query(d),
    "toxicity": lambda d, l: toxicity.query(d, l),
    "quality": lambda d, l: quality.query(d, l),
    "neardup": lambda d, l: neardup.query(d),
    "packing": lambda d, l: packing.query(d, P.path("byte_bpe_50k.json")),
    "spotsigs": lambda d, l: spotsigs.query(d),
    "alignment": lambda d, l: alignment.query(d, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")),
    "jaccard": lambda d, l: jaccard.query(d),
}
STAGES = {
    "toxicity": lambda d, l: toxicity.stage(d, l),
    "lines": lambda d, l: lines.stage(d),
    "neardup": lambda d, l: neardup.stage(d),
    "secrets": lambda d, l: secrets.stage(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_all_come_back(odd, no_labels, name):
    out = QUERIES[name](odd, no_labels)
    ids = sorted((r.doc_id is None, r.doc_id) for r in out.select("doc_id").collect())
    want = sorted((r.doc_id is None, r.doc_id) for r in odd.select("doc_id").collect())
    assert set(ids) == set(want)
    if name != "packing":
        assert ids == want


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(empty, no_labels, name):
    assert QUERIES[name](empty, no_labels).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_clashing_columns(clashing, no_labels, name):
    assert QUERIES[name](clashing, no_labels).select("doc_id").distinct().count() == 3


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(odd, empty, clashing, no_labels, name):
    for docs in (odd, empty, clashing):
        out = STAGES[name](docs, no_labels)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        n = out.count()
        if name in ("lines", "secrets"):
            assert n == docs.count()
    extra = STAGES[name](clashing, no_labels).select("score", "sequence_id", "key").distinct().collect()
    assert [tuple(r) for r in extra] == [("x", "x", "x")]


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secrets", "packing"]


def test_hamming_edges(spark):
    kind = "vec_id bigint, embedding array<float>, label int, distance int"
    rows = [(0, [1.0, -1.0], 0, 9), (0, [1.0, -1.0], 0, 9), (1, None, 0, 9), (None, [1.0, 1.0], 0, 9), (2, [None, 1.0], 0, 9),
            (3, [1.0, -2.0], 0, 9), (4, [1.0], 0, 9)]
    out = hamming.query(spark.createDataFrame(rows, kind)).collect()
    assert [tuple(r) for r in sorted(out)] == [(0, 2, 2, 2), (0, 3, 0, 1)]
    assert hamming.query(spark.createDataFrame([], kind)).count() == 0


def test_jaccard_and_alignment_of_odd_rows(odd):
    of = {(r.doc_id, r.n_shingles): r for r in jaccard.query(odd).collect()}
    assert of[1, 2].component_id == 1 and of[8, 2].component_id == 1 and of[1, 2].component_size == 3
    assert of[2, 0].component_id == 2 and of[None, 1].component_id is None and of[5, 1].component_id == 5
    a = {r.doc_id: r for r in alignment.query(odd, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()}
    for i in (2, 3, 7):
        assert (a[i].n_a, a[i].n_b, a[i].n_groups, a[i].n_links, a[i].n_best, a[i].count_sum, a[i].groups_sha256) == (0,) * 6 + ("",)
    assert a[1] .n_links == a[8].n_links > 0 and a[4].n_a > 40_000


def test_collocations_edges(spark, odd, empty, clashing):
    got = [tuple(r) for r in collocations.query(odd).collect()]
    assert [r[:3] for r in got] == [("en", 1, "word word word word")]
    assert collocations.query(empty).count() == 0 and collocations.query(clashing).count() == 0
