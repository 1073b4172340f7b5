"""Near duplicates: words counted over all texts, and the pairs that hubs leave out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from civicspan.llm import gru_lm, order_minhash, sharding
from civicspan.llm.common import written


def test_common_words_are_counted_over_all_nodes(spark):
    texts = [np.arange(10 * i, 10 * i + 3) for i in range(600)]
    texts += [np.concatenate([np.arange(10**6, 10**6 + 2100), [7]]) for _ in range(60)]
    rows = [(len(t), t.astype("<u4").tobytes()) for t in texts]
    nodes = spark.createDataFrame(rows, "n long, words binary").coalesce(1).orderBy("n")
    assert order_minhash.common_words(nodes).tolist() == [7, *range(10**6, 10**6 + 2100)]
    assert order_minhash.common_words(nodes.where("n < 0")).tolist() == []


def crowd(some, passage, own, edits, words, many, pairs):
    shared = [f"p{i}" for i in range(passage)]
    texts = [shared + [f"w{some.randrange(words)}" for _ in range(own)] for _ in range(many)]
    for t in texts[:pairs]:
        made = list(t)
        for at in some.sample(range(passage, passage + own), edits):
            made[at] = f"e{some.randrange(10**9)}"
        texts.append(made)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_no_link_of_a_bucket_is_lost_behind_hubs(spark):
    docs = crowd(random.Random(4), 155, 45, 38, 20_000, 450, 150)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()}
    hashed = {i: order_minhash.word_hashes(t.encode()) for i, t in docs.items()}
    keys = {i: set(order_minhash.keys_of(h).tolist()) for i, h in hashed.items()}
    linked = [(a, a + 450) for a in range(150) if order_minhash.similar(hashed[a], hashed[a + 450]) and keys[a] & keys[a + 450]]
    assert len(linked) > 100 and [(a, b) for a, b in linked if got[a] != got[b]] == []


def test_rest_pairs_of_large_buckets_are_all_found_once(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "NODES_A_TASK", 4)
    some = random.Random(2)
    texts = [order_minhash.word_hashes(t.encode()) for t in crowd(some, 20, 20, 7, 9999, 12, 6).values()]
    name = [f"{i:02}".encode() for i in range(len(texts))]
    nodes = spark.createDataFrame([(x, len(t), (t >> np.uint64(32)).astype("<u4").tobytes()) for x, t in zip(name, texts)], "node binary, n long, words binary")
    buckets = spark.createDataFrame([(k, x, len(t)) for k in (1, 2) for x, t in zip(name, texts)], "key long, node binary, n long")
    live = order_minhash.live_buckets(buckets, None)
    tested = spark.createDataFrame([(name[0], name[12])], "a binary, b binary")
    rest = order_minhash.rest_pairs(live, nodes, tested, 0.8).collect()
    found = {(bytes(r["under"]), bytes(r["over"])) for r in rest}
    linked = {(name[i], name[j]) for j in range(18) for i in range(j) if order_minhash.similar(texts[i], texts[j])}
    assert len(rest) == len(found) and len(linked) == 6 and linked - found == {(name[0], name[12])}


def test_bags_rule_out_no_link_and_most_others(spark):
    some = random.Random(3)
    texts = [t.split() for t in crowd(some, 30, 10, 4, 9999, 20, 10).values()]
    texts += [["often"] * 300 + t for t in texts[:8]] + [["often"] * 290 + t for t in texts[4:12]]
    hashed = [order_minhash.word_hashes(" ".join(t).encode()) for t in texts]
    rows = [(bytes([i]), len(t), (t >> np.uint64(32)).astype("<u4").tobytes()) for i, t in enumerate(hashed)]
    nodes = spark.createDataFrame(rows, "node binary, n long, words binary")
    bags = nodes.select("node", "n").join(order_minhash.bags_of(nodes), "node")
    pairs = bags.crossJoin(bags.toDF("hub", "hub_n", "hub_bag")).where("node < hub")
    near = pairs.where(order_minhash.near_bags("n", "hub_n", "bag", "hub_bag", 0.8)).select("node", "hub").collect()
    near = {(r["node"][0], r["hub"][0]) for r in near}
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if order_minhash.similar(hashed[i], hashed[j])}
    assert len(linked) > 10 and linked <= near and len(near) < pairs.count()


def test_a_round_works_its_wishes_out_once(spark):
    docs = spark.createDataFrame([(i, f"a line that is shared by group {i % 7}\nand an own line of text {i}") for i in range(60)], "doc_id long, text string")
    units, edges = sharding.units_and_edges(written(sharding.prepare(docs), "rows"))
    labels, room = sharding.first_labels(units, 4)
    moved = sharding.propagate(written(labels, "labels"), edges, room)
    assert edges.count() == 60 and not set(moved.inputFiles()) & set(edges.inputFiles())


def test_odds_are_made_to_learn_only():
    some = np.random.default_rng(1)
    logits, chosen = some.normal(0, 2, (9, 5)), some.integers(0, 5, 9)
    shares = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    for learn in (False, True):
        score, odds = gru_lm._odds(logits.copy(), np.arange(9), chosen, learn)
        assert np.allclose(score, np.log(shares[np.arange(9), chosen]))
        assert np.allclose(odds, shares if learn else np.exp(logits))


def test_pairs_of_cells_are_those_that_bags_allow(spark):
    some = random.Random(5)
    texts = [order_minhash.word_hashes(t.encode()) for t in crowd(some, 20, 20, 7, 300, 40, 20).values()]
    name = [f"{i:02}".encode() for i in range(len(texts))]
    rows = [(x, len(t), (t >> np.uint64(32)).astype("<u4").tobytes()) for x, t in zip(name, texts)]
    nodes = spark.createDataFrame(rows, "node binary, n long, words binary")
    bags = nodes.select("node", "n").join(order_minhash.bags_of(nodes), "node")
    near = bags.crossJoin(bags.toDF("hub", "hub_n", "hub_bag")).where(order_minhash.near_bags("n", "hub_n", "bag", "hub_bag", 0.8))
    allowed = {(bytes(r["node"]), bytes(r["hub"])) for r in near.where("node < hub").select("node", "hub").collect()}
    bag = {bytes(r["node"]): r["bag"] for r in bags.collect()}
    # Two buckets in two blocks each; every cell has the rows of its blocks.
    cells = [(k, low, high) for k in (0, 1) for low, high in ((0, 0), (0, 1), (1, 1))]
    made = [
        {"key": k, "low_block": low, "high_block": high, "block": at // 7 % 2, "node": name[at], "class": name[at], "n": len(texts[at]), "salts": 2, "bag": bag[name[at]]}
        for k, low, high in cells
        for at in range(k, 60, 2)
        if at // 7 % 2 in (low, high)
    ]
    schema = pa.schema({"key": pa.int64(), "low_block": pa.int32(), "high_block": pa.int32(), "block": pa.int32(), "node": pa.binary(), "class": pa.binary(), "n": pa.int64(), "salts": pa.int32(), "bag": pa.list_(pa.int8())})
    batch = pa.RecordBatch.from_pylist(sorted(made, key=lambda r: (r["key"], r["low_block"], r["high_block"])), schema)
    found = [(r["node"], r["hub"]) for b in order_minhash.cell_pairs(batch, 0.8) for r in b.to_pylist()]
    together = {(a, b) for a, b in allowed if (name.index(a) - name.index(b)) % 2 == 0}
    assert sorted(found) == sorted(together) and len(found) > 5
    assert list(order_minhash.cell_pairs(batch.slice(0, 0), 0.8)) == []


def test_words_of_many_texts_are_those_of_each():
    texts = ["", None, " a\tB\x0b\x0cc\n", "Äß x", "\x1c y z", "  ", "end"]
    lists = gru_lm.words_in(pa.array(texts)).to_pylist()
    assert [[w for w in words if w] for words in lists] == [gru_lm.words_of((t or "").encode()) for t in texts]


def test_scoring_in_longer_windows_where_few_lanes_are_left():
    words = [b"w%d" % i for i in range(30)]
    lex = gru_lm.Lexicon(words, np.arange(30, 0, -1), 1, 465, 30)
    network = gru_lm.Network(gru_lm.first_weights(lex))
    some = np.random.default_rng(2)
    documents = [some.integers(-1, 30, n).astype("<i4") for n in (900, 40, 7, 1, 33)]
    steps = []

    def forward(reads, begins, state, real=network.forward):
        steps.append(reads.shape)
        return real(reads, begins, state)

    network.forward = forward
    scores = network.run(documents, lex, learn=False)
    assert steps == [(900, 5)] and np.allclose(scores, [network.run([d], lex, learn=False)[0] for d in documents])
