"""The operators' methods against plain versions, and what their parameters promise."""

import base64
import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lithoscan.llm import packing, quality_model, quality_rules, queries, sharding, spotsigs, substrings, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


# --- packing --------------------------------------------------------------------------


def plain_fillings(counts, room):
    sizes = sorted(counts)
    out = []
    for mult in itertools.product(*[range(min(counts[s], room // s) + 1) for s in sizes]):
        f = [s for m, s in zip(mult, sizes, strict=True) for _ in range(m)]
        if sum(f) > room:
            continue
        subs = {sub for k in range(len(f) + 1) for sub in itertools.combinations(f, k)}
        spare = [x for x in sizes if counts[x] > f.count(x)]
        if not any(x <= sum(s) + room - sum(f) and (x > sum(s) or (x == sum(s) and len(s) > 1)) for s in subs for x in spare):
            out.append(tuple(sorted(f, reverse=True)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_fillings_are_all_undominated_ones_by_waste(seed):
    rng = random.Random(seed)
    room = rng.randrange(5, 26)
    counts = {rng.randrange(1, room + 1): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
    got = list(packing.fillings(counts, room))
    assert sorted(got) == plain_fillings(counts, room)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def optimum(items, room):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= room:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(150))
def test_unbounded_search_is_optimal(seed):
    rng = random.Random(seed)
    room = rng.randrange(8, 40)
    items = sorted((rng.randrange(1, room + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
    patterns = packing.bin_completion(dict(collections.Counter(items)), room, None)
    used = collections.Counter()
    for f, m in patterns:
        assert sum(f) <= room
        for s in f:
            used[s] += m
    assert used == collections.Counter(items) and sum(m for _, m in patterns) == optimum(items, room)


def test_few_open_choices_change_nothing(monkeypatch):
    counts = {s: 2 for s in range(300, 900, 31)}
    want = packing.bin_completion(counts, 2048, 3000)
    monkeypatch.setattr(packing, "OPEN", 2)
    assert packing.bin_completion(counts, 2048, 3000) == want


def test_documents_need_no_more_sequences_than_the_bound(spark):
    got = queries.QUERIES["op10_packing"](spark, SF).collect()
    short = collections.Counter(r["length"] for r in got if r["length"] < 2048)
    assert len({r["sequence_id"] for r in got if r["length"] < 2048}) == packing.lower_bound(short, 2048)
    full = [r["sequence_id"] for r in got if r["length"] == 2048]
    assert len(full) == len(set(full)) and not set(full) & {r["sequence_id"] for r in got if r["length"] < 2048}


# --- sharding --------------------------------------------------------------------------


def test_capacity_is_held_where_classes_hold_several_sizes(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, str(i) + "x" * rng.randrange(1, 9000)) for i in range(900)], "doc_id long, text string")
    capacity = 1 << 16  # classes of four bytes
    load = collections.Counter()
    for r in sharding.shard(docs, None, capacity).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= capacity and len(load) <= 1.02 * sum(load.values()) / capacity + 1


def test_shards_are_balanced(spark, texts):
    load = collections.Counter()
    for r in queries.QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 40 and max(load.values()) <= 1.01 * min(load.values())


# --- quality rules -----------------------------------------------------------------------


def test_least_determinant_beats_plain_searches(spark):
    rng = np.random.default_rng(5)
    n = 240
    z = np.column_stack([rng.normal(1.6, 0.05, n), rng.exponential(0.1, n), rng.choice([0, 0, 0.5], n), rng.beta(1, 8, n)])
    z[:40] += [0.8, 1.5, 0.6, 0.3]  # a cluster far off
    rows = [(i, "en", "a", i, 100, 0, *map(float, z[i])) for i in range(n)]
    t = spark.createDataFrame(rows, "doc_id long, lang string, source string, text_hash long, n_words long, n_repeat_words long, " + ", ".join(f"{c} double" for c in quality_rules.NAMES))
    _, found = quality_rules.estimates(t)
    got = found.first()
    floor = np.diag([quality_rules.FLOOR[c] ** 2 for c in quality_rules.NAMES])
    h = int(quality_rules.CORE * n)

    def search(own):
        last = np.inf
        for _ in range(100):
            m, c = z[own].mean(axis=0), np.cov(z[own].T, bias=True) * quality_rules.SCALE + floor
            if len(own) == h:  # the few rows of a start are no candidate
                det = np.linalg.slogdet(c)[1]
                if det > last - 1e-9:
                    return last
                last = det
            d = z - m
            own = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d), kind="stable")[:h]
        return last

    best = min(search(rng.choice(n, 12, replace=False)) for _ in range(200))
    assert got["log_det"] <= best + 0.02
    assert abs(got["m_0"] - z[40:, 0].mean()) < 0.03  # the cluster isn't in it


def test_each_group_may_have_its_own_estimate(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}{k}" for k in range(60)), "en", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    z = quality_rules.transformed(quality_rules.base_statistics(docs))
    keyed, _ = quality_rules.estimates(z, least_rows=0)
    assert keyed.select("key").distinct().count() == 3
    keyed, _ = quality_rules.estimates(z)
    assert keyed.select("key").distinct().count() == 1


# --- toxicity -----------------------------------------------------------------------------


def test_transducers_read_what_the_others_write():
    read = toxicity.Reader({"idiot$": 3.0, "kill>": 4.0}).summary
    score = lambda t: read(t)[0]
    assert score("idiot, you are") > score("idiot here now") < score("you are an idiot")  # a target reaches both ways
    assert score("you are not an idiot") < score("what idiot here")  # denied first, so the target sharpens nothing
    assert score("an idiot, he said") < score("an idiot, he ran")
    assert score("i will kill you") > score("i will kill time") == 0.0
    assert score("i will hurt you") > 0  # a fixed word that no label taught
    composed = toxicity.compose(toxicity.FORWARD)
    states = {0}
    for word in itertools.product(range(6), repeat=4):
        state, parts = 0, [0] * len(toxicity.FORWARD)
        for symbol in word:
            state, written, factor = composed.step(state, symbol)
            out, weight = symbol, 1.0
            for k, t in enumerate(toxicity.FORWARD):
                parts[k], out, own = t.step(parts[k], out)
                weight *= own
            assert (written, factor) == (out, weight)
            states.add(state)
    assert len(states) > 5


@pytest.mark.parametrize(("name", "label"), [("op6_quality_model", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_precision_and_recall(spark, name, label):
    sf = "/root/testdata/sf0.1"
    score = {"quality": quality_model.score, "toxic": toxicity.score}[label]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")  # only labelled ones can be counted
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    held = [(got[i]["predicted"], got[i]["score"], y) for i, y in duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall() if i in got and got[i]["held_out"]]
    hit = sum(p and y for p, _, y in held)
    assert hit / sum(y for *_, y in held) >= 0.9 and hit / sum(p for p, *_ in held) >= 0.9
    pos, neg = [s for _, s, y in held if y], [s for _, s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) >= 0.95


# --- URL filter --------------------------------------------------------------------------


def test_links_have_a_host_of_their_own(spark):
    html = (
        '<a href="http://one.org/x">a</a><A class=q HREF=//two.org>b</A><a href="/go?u=http://three.org">c</a><a href="four.org/x">d</a>'
        '<!-- <a href="http://five.org">e</a> --><script>var s = "<a href=\'http://six.org\'>";</script><style>a{}</style><img href="http://seven.org"><a href="http://me.org/x">self</a>'
    )
    pages = spark.createDataFrame([("me.org", html), ("me.org", None), ("", '<a href="http://x.org">')], "host string, html string")
    assert {(r["src"], r["dst"], r["n"]) for r in url_filter.host_edges(pages).collect()} == {("me.org", "one.org", 1), ("me.org", "two.org", 1)}


def test_pages_without_a_rule_are_judged_by_their_host(spark):
    """The documents' pages link to no other host, so walks stay at their seeds."""
    got = queries.QUERIES["op5_url_filter"](spark, SF).collect()
    by = collections.defaultdict(collections.Counter)
    fits = {r.name: r.verdict for r in url_filter.RULES}
    for r in got:
        by[r["host"]][fits.get(r["rule"], "none")] += 1
    for r in got:
        if r["rule"] is None:
            c = by[r["host"]]
            share = c["block"] / max(c["block"] + c["allow"] + c["none"], 1)
            assert r["verdict"] == ("block" if r["host"] and share > 0.5 else "allow")


# --- SpotSigs ------------------------------------------------------------------------------


def plain_spots(text):
    words = re.findall(r"\w+", text.lower())
    found, content = set(), [w for w in words if w not in spotsigs.ANCHORS]
    seen = 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if seen + spotsigs.CHAIN <= len(content):
                found.add(xxhash.xxh32_intdigest(f"{w} {' '.join(content[seen : seen + spotsigs.CHAIN])}"))
        else:
            seen += 1
    for i in range(len(words) - spotsigs.CHAIN):
        h = xxhash.xxh32_intdigest(" ".join(words[i : i + spotsigs.CHAIN + 1]))
        if h % spotsigs.EVERY == 0:
            found.add(h)
    return found or ({xxhash.xxh32_intdigest(" ".join(words) or text)} if text.strip() else set())


def test_fingerprints_are_the_plain_sets(spark, texts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_spotsigs"](spark, SF).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(ids):
        r, t, after = got[i], texts[i], texts[ids[(k + 1) % len(ids)]]
        own = set(np.frombuffer(base64.b64decode(r["fingerprint"]), "<u4").tolist())
        changed = plain_spots(t[: len(t) - len(t) // 3] + after[: len(t) // 3])
        assert own == plain_spots(t)
        assert r["near_edited"] == pytest.approx(alike(own, changed)) and r["near_next"] == pytest.approx(alike(own, plain_spots(after)))


# --- substrings -----------------------------------------------------------------------------


def test_classes_keepers_and_removals(spark):
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    p, q, whole = new(70), new(60), new(30)
    near = [*q[:30], "changed", *q[31:]]  # 51 of 61 shingles
    docs = [(5, [*new(30), *p, *new(30)]), (3, [*new(45), *p, *new(12)]), (9, [*p, *new(20)]), (1, new(90)), (7, whole), (8, whole), (2, whole)]
    rows = [(i, " ".join(w)) for i, w in docs] + [(20, " ".join(new(25)) + "\n" + " ".join(q)), (21, " ".join(near) + "\n" + " ".join(new(33)))]
    rows = [*rows, (None, " ".join(p))]
    got = substrings.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["class_id"]].add((r["doc_id"], r["keeper"], r["removed"]))
    for members in by.values():
        keeper = min(i for i, *_ in members)
        assert len({i for i, *_ in members}) > 1 or members  # a side's run may stand for one document's part of a longer class
        assert all(k <= i and removed == (i != k) for i, k, removed in members) and keeper >= min(k for _, k, _ in members)
    gone = collections.defaultdict(set)
    for r in got:
        if r["removed"]:
            gone[r["doc_id"]] |= set(range(r["start"], r["start"] + r["n_words"]))
    assert gone == {5: set(range(30, 100)), 9: set(range(70)), 7: set(range(30)), 8: set(range(30)), 21: set(range(60))}


def test_recall_of_near_lines(spark):
    rng = random.Random(11)
    docs, pairs = [], 0
    for k in range(150):
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(48, 90))]
        other = list(base)
        for at in rng.sample(range(5, len(base) - 5), 1):
            other[at] = "changed"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs += 1
    got = substrings.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"))
    whole = {r["doc_id"] for r in got.where("removed and start = 0 and n_words >= 48").collect()}
    assert len(whole) >= 0.9 * pairs  # 0.98 by the bands at a likeness of 0.8


# --- pipeline -------------------------------------------------------------------------------


def test_stages_on_odd_rows(spark):
    prose = "the small river runs down to the old town and many people walk along its quiet banks in the evening light of late summer days while boats pass slowly under the stone bridge and children throw bread to the ducks that gather near the wooden pier where an old man sells tickets for a short ride upstream past the mill"
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose + " again", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \n\t", None, "b"), (None, prose + " nobody", "en", "a"), (6, " ".join(f"word{i}" for i in range(9000)), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("fp", "unit", "tokens", "copies", "kept", "spans", "row", "domain", "n_words"):
        docs = docs.selectExpr("*", f"doc_id as `{c}`")
    for none in (False, True):
        now = docs.limit(0) if none else docs
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = stage(spark, now, SF)
            assert name == "packing" or now.columns == before.columns
            if name == "near_dedup":
                assert {r["doc_id"] for r in now.collect()} == (set() if none else {1, None, 6})
        found = now.collect()
        assert not found if none else {r["doc_id"] for r in found} <= {1, None, 6}


def test_crc_of_pieces(spark, texts):
    got = queries.QUERIES["op10_packing"](spark, SF).where("piece = 0 and start = 0").collect()
    ids = packing.Ids(packing.tokenizer_path())
    for r in got[:50]:
        data = ids.whole(texts[r["doc_id"]]) + b"\0\0\0\0"
        assert r["ids_crc32"] == zlib.crc32(data[: 4 * r["length"]])
