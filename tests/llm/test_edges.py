"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from lithoscan.llm import mixing, packing, quality_model, quality_rules, sharding, simhash, spotsigs, substrings, toxicity, url_filter

PROSE = "the small river runs down to the old town and many people walk along its quiet banks in the evening light of late summer days"
ROWS = [
    (1, PROSE * 4, "en", "a"),
    (2, PROSE * 4, "en", "a"),
    (2, PROSE * 4, "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, "  \n\t ", None, "b"),
    (None, PROSE, "en", "a"),
    (6, " ".join(f"word{i}" for i in range(60_000)), "en", "b"),
    (7, "a", "en", "b"),
    (8, "é ü 字 <|endoftext|> 🙂", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use for their own columns.
CLASH = ["fp", "component_id", "root", "node", "unit", "bands", "tokens", "copies", "domain", "rank", "shard", "slot", "digest", "words", "t", "key", "f", "piece", "length", "score", "held_out", "y", "start", "__spans", "__part", "distance", "kept", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        d = d.selectExpr("*", f"doc_id as `{c}`")
    return d


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1), (7, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_simhash(docs, none):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    by = {r[1]: r for r in got if not r[0]}
    assert len(got) == len(ROWS)
    assert by[2][3] == 1 and by[4][2] == by[3][2] == 0 and by[4][3] == by[3][3] == by[5][3] == 3
    assert [r[3] for r in got if r[0]] == [None]
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]


def test_quality_rules(docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[1]["n_repeat_words"] > 0 and by[6]["n_words"] == 60_000 and by[6]["n_repeat_words"] == 0
    assert quality_rules.judge(none).collect() == []
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_substrings(docs, none):
    got = substrings.repeated_paragraphs(docs).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    assert all(r["removed"] == (r["doc_id"] == 2) and r["keeper"] == 1 for r in got)
    assert substrings.repeated_paragraphs(none).collect() == []
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == PROSE * 4 and texts[6] == ROWS[7][1] and texts[3] is None and len(texts.get(2, "")) < len(PROSE * 4)


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["_tokens", "_copies"]
    assert all(1 <= r["_copies"] <= 4 for r in out.collect())
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_sharding(docs, none):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(ROWS)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {16}
    assert sharding.shard(none, 3).collect() == []
    assert len(sharding.shard(docs, None, capacity=2000).collect()) == len(ROWS)


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert [r["length"] for r in got if r["doc_id"] in (3, 4)] == [1, 1]
    assert sum(r["length"] for r in got if r["doc_id"] == 6) > 60_000
    assert packing.pack(none).collect() == []


def test_spotsigs(docs, none):
    got = spotsigs.compare_with_edits(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert spotsigs.compare_with_edits(none).collect() == []
    classes = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs).collect()}
    assert classes[1] == classes[2] == 1 and classes[3] == classes[4] == 3 and classes[None] is None
    assert spotsigs.near_duplicates(none).collect() == []


def test_single_document_is_its_own_next(spark):
    (r,) = spotsigs.compare_with_edits(spark.createDataFrame([(5, "abcdef", "en", "a")], SCHEMA)).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 6


@pytest.mark.parametrize("score", [quality_model.score, toxicity.score])
def test_classifiers(score, docs, none, labels, no_labels):
    for given in (labels, no_labels):
        got = score(docs, given).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert score(none, labels).collect() == []


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/x?q#f", None), (2, None, "<a href='http://x.org/'>x</a>"), (3, "no scheme", ""), (4, "http://b.net", "x"),
        (5, "https://www.example.com/en/1", ""), (5, "https://www.example.com/en/1", ""), (None, "ftp://c.net/fr/#x", ""), (6, "://", ""), (7, "http://com/", ""),
    ]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host long, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == got[3] == got[6] == ("", "", None, "allow")
    assert got[4] == ("b.net", "", None, "allow")
    assert got[5] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[None] == ("c.net", "/fr/", "net/fr/", "block")
    assert got[7] == ("com", "/", "com/", "allow")
    assert url_filter.judge(pages.limit(0)).collect() == []
