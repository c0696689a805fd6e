"""That the stages do their whole job: cases that cuts in them have missed."""

import logging
import random

import corpus_pipeline
from lithoscan.llm import packing, simhash, spotsigs, substrings

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_removes_five_word_jaccard(spark):
    rng = random.Random(4)
    texts = []
    for n in (60, 120, 300, 800) * 5:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        edited = list(base)
        for k in range(n // 60):  # spread out, 5 shingles each
            edited[60 * k + 30] = "other"
        texts += [" ".join(base), " ".join(edited)]
    pairs = [(k, k + 1) for k in range(0, len(texts), 2)]
    sets = [shingles(t) for t in texts]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in pairs)
    far = [(a, b) for a, b in pairs if (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() > 3]
    assert far
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {a for a, _ in pairs}


def test_near_dedup_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: shingles(t or "") for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a]) * 0.8 <= len(sets[b]) <= len(sets[a]) / 0.8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert pairs and all(of[a] == of[b] for a, b in pairs)


def test_pipeline_near_dedup_by_brute_force(spark):
    """Both kinds of links, on what the quality rules keep."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 3 or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, good, SF).collect()} == {root(i) for i in texts}


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    return out


def test_substrings_find_passages_changed_in_the_middle(spark):
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = [], {}
    for k, n in enumerate((51, 55, 60, 80, 100) * 4):
        base = new(n)
        edited = [*base[: n // 2], "other", *base[n // 2 + 1 :]]
        for i, p in ((2 * k, base), (2 * k + 1, edited)):
            docs.append((i, "\n".join(" ".join(x) for x in (new(40), p, new(30)))))
            want[i] = set(range(40, 40 + n))
    got = covered(substrings.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert all(want[i] <= got.get(i, set()) for i in want)


def test_substrings_cover_every_shared_word(spark):
    rng = random.Random(6)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, want, gone = [], {}, {}
    for k, n in enumerate((51, 55, 60, 73, 100, 150, 400) * 4):
        base = new(n)
        for i in (3 * k, 3 * k + 1, 3 * k + 2):  # the second one has only the second half
            part = base if i % 3 != 1 else base[n // 2 :]
            docs.append((i, " ".join([*new(35), *part, *new(35)])))
            if i % 3 != 1 or len(part) > 50:
                want[i] = set(range(35, 35 + len(part)))
            if i % 3 == 2:
                gone[i] = want[i]
    for i, n in enumerate((51, 100, 333)):
        whole = " ".join(new(n))
        docs += [(1000 + 2 * i, whole), (1001 + 2 * i, whole)]
    turns = " ".join(["a b c d e f g"] * 40)  # words that repeat in turn
    docs += [(2000, " ".join([*new(30), turns, *new(30)])), (2001, " ".join([*new(45), turns, *new(3)]))]
    want[2000], want[2001] = set(range(30, 310)), set(range(45, 325))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_paragraphs(df).collect()
    got, cut = covered(found), covered([r for r in found if r["removed"]])
    assert {i: sorted(want[i] - got.get(i, set())) for i in want if not want[i] <= got.get(i, set())} == {}
    assert all(gone[i] <= cut.get(i, set()) for i in gone)
    words = {i: t.split() for i, t in docs}
    where = {}
    for i, w in words.items():
        for k in range(len(w)):
            where.setdefault(w[k], set()).add(i)
    assert all(len(where[words[i][k]]) > 1 for i, ks in got.items() for k in ks)
    left = {r["doc_id"] for r in substrings.remove_repeats(df).collect()}
    assert left == words.keys() - {1001, 1003, 1005}
    # every shared passage of documents
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = covered(substrings.repeated_paragraphs(docs).collect())
    words = {r["doc_id"]: r["text"].lower().split() for r in docs.collect() if r["text"].isascii()}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add((i, k))
    shared = [p for ps in where.values() if len({i for i, _ in ps}) > 1 for p in ps]
    assert shared and all(set(range(k, k + 51)) <= got[i] for i, k in shared)


def test_spots_do_not_jump_with_one_word():
    rng = random.Random(7)
    for n in range(9, 16):  # anchors; the step was at 12 spots
        words = []
        for k in range(n):
            words += ["the", *[f"c{rng.randrange(10**6)}" for _ in range(9)]]
        less = words[:10] + words[11:]  # one anchor fewer
        a, b = spotsigs.spots(" ".join(words)), spotsigs.spots(" ".join(less))
        assert spotsigs.likeness(a, b) > 0.8, n


def test_rows_of_one_document_are_one_component(spark):
    rng = random.Random(8)
    new = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = new(), new(), new()
    docs = spark.createDataFrame([(1, a), (3, a), (3, b), (4, b), (5, c)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (3, 1), (4, 1), (5, 5)}


def test_packing_logs_its_gap(spark, caplog):
    docs = spark.createDataFrame([(i, "word " * (20 * i + 1)) for i in range(9)], "doc_id long, text string")
    with caplog.at_level(logging.INFO, logger=packing.__name__):
        used = packing.pack(docs).where("length < 2048").select("sequence_id").distinct().count()
    assert any(f"{used} sequences" in m and "lower bound" in m for m in caplog.messages)
