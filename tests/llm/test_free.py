"""The operators with Python in their tasks, against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civicspan.llm import bpe, decontamination, gru_lm, order_minhash, queries, token_store, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# Decontamination.


def brute_hits(text, items, window=10):
    found = collections.defaultdict(set)
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            found[tuple(w[i : i + size])].add(name)
    w, hit, names = words(text), set(), set()
    for size in {len(k) for k in found}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in found:
                hit.update(range(i, i + size))
                names |= found[tuple(w[i : i + size])]
    return len(w), len(hit), names


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("abc ", max_size=30), max_size=5),
    st.lists(st.text("abcd ", max_size=60), min_size=1, max_size=4),
    st.integers(2, 4),
)
def test_automaton_equals_brute_force(items, texts, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = decontamination.SuffixAutomaton([(n, t.encode()) for n, t in named], window)
    for text, (n, spans, found) in zip(texts, decontamination.scan(automaton, [t.encode() for t in texts]), strict=True):
        expected = brute_hits(text, named, window)
        assert (n, sum(b - a for a, b in spans), {automaton.names[i] for i in found}) == expected
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_contamination_of_all_documents(spark, small, small_docs):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, small).collect()}
    for doc, text in zip(small_docs.doc_id, small_docs.text, strict=True):
        n, hit, names = brute_hits(text, items)
        row = got[doc]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (n, hit, len(names), hit > 0)
        assert row["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_blocks_give_the_same_as_one(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"]
    one = decontamination.find_contamination(docs, items).select(columns).collect()
    several = decontamination.find_contamination(docs, items, block_words=100).select(columns).collect()
    assert sorted(one) == sorted(several)


def test_spans_are_removed_and_clean_documents_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    filler = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{filler}, {item.upper()}! and on"), (2, filler), (3, item), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, None), (7, "...")], "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items).collect()}
    assert kept == {1: f"{filler}, ! and on", 2: filler, 4: None}


def test_contamination_of_messy_rows(spark, messy, nothing):
    items = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "word1 ünïcode")], "item_id long, text string")
    rows = decontamination.find_contamination(messy, items)
    assert set(rows.columns) >= set(messy.columns)
    got = {(r["doc_id"], r["text"]): r for r in rows.collect()}
    assert got[(7, "one two")]["n_hit"] == 2 and got[(7, "one two")]["items"] == "1"
    assert got[(3, None)]["n_words"] == 0
    assert decontamination.find_contamination(nothing, items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.find_contamination(messy, none).collect()} == {0}


# BPE.


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(bpe.read_vocabulary(queries.vocabulary_path()))


HARD = [
    "", " ", "\n\n \t x", "a" * 300, "!" * 500, " " * 777 + "end", "don't we'll 'S it's' ''s", "<|endoftext|>", "x<|endoftext|><|endoftext|> y",
    "naïve café 東京 Ελλάδα Привет 🙂🙂 𝔘𝔫𝔦", "١٢٣ ²³ Ⅷ ½", "  x　 y\x1c\x1d z\x85", "\x00\x01\x7f", "é‍", "1234567890" * 20, "==========----____",
]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab cd'st\n!1 é", max_size=120), st.sampled_from(HARD)))
def test_ids_equal_the_library(text):
    tokenizer = Tokenizer.from_file(queries.vocabulary_path()) if not hasattr(test_ids_equal_the_library, "t") else test_ids_equal_the_library.t
    test_ids_equal_the_library.t = tokenizer
    vocabulary, pieces = bpe.encoder(bpe.read_vocabulary(queries.vocabulary_path()))
    ids = np.frombuffer(pieces.encode(text), "<u4")
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected
    assert vocabulary.decode(ids.astype(np.int64)).decode() == text == tokenizer.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text, library, coder):
    assert np.frombuffer(coder[1].encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    stored = token_store.library_encoder(bpe.read_vocabulary(queries.vocabulary_path())).encode(text)
    assert np.frombuffer(stored, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids_equals_the_library(library, coder):
    rng = np.random.default_rng(3)
    for _ in range(50):
        ids = rng.integers(0, 50257, 20)
        assert coder[0].decode(ids).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_tokens_of_all_documents(spark, small, small_docs, library):
    got = {r["doc_id"]: r for r in queries.op8_backtracking_bpe(spark, small).collect()}
    stored = {r["doc_id"]: r for r in queries.op10_elias_fano_store(spark, small).collect()}
    start = 0
    for doc, text in sorted(zip(small_docs.doc_id, small_docs.text, strict=True)):
        ids = library.encode(text, add_special_tokens=False).ids
        row = got[doc]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        ids.append(2)
        row = stored[doc]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_tokens_of_messy_rows(messy, nothing):
    path = queries.vocabulary_path()
    coded = bpe.encode_texts(messy, path, decoded="decoded")
    rows = coded.collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert [bytes(r["ids"]) for r in rows if r["text"] is None] == [b"", b""]
    again = bpe.decode_ids(coded.drop("decoded"), path).collect()
    assert sorted(r["decoded"] for r in again) == sorted(r["decoded"] for r in rows)
    assert bpe.encode_texts(nothing, path).collect() == []


# Token store.


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values.sort()
    sequence = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert sequence.values().tolist() == values
    assert [sequence[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    coded = token_store.EliasFano.of(ends).to_bytes()
    assert len(coded) * 8 / len(ends) < 2 + math.log2(ends[-1] / len(ends)) + 1.5


def test_store_of_messy_rows(spark, messy, nothing):
    path = token_store.write_store(messy, queries.vocabulary_path())
    rows = token_store.read_documents(spark, path).join(token_store.block_starts(spark, path), ["shard", "block"]).collect()
    rows.sort(key=lambda r: r["block_start"] + r["place"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 7]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    for at, following in zip(rows, rows[1:], strict=False):
        assert at["block_start"] + at["place"] + at["n_tokens"] == following["block_start"] + following["place"]
    first = next(r for r in rows if r["place"] > 0)
    place = sorted(r["place"] for r in rows if (r["shard"], r["block"]) == (first["shard"], first["block"])).index(first["place"])
    assert token_store.document(spark, path, first["shard"], first["block"], place).astype("<u4").tobytes() == bytes(first["ids"])
    empty = token_store.write_store(nothing, queries.vocabulary_path())
    assert token_store.read_documents(spark, empty).join(token_store.block_starts(spark, empty), ["shard", "block"]).collect() == []


# Near duplicates.


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


sequences = st.lists(st.integers(0, 3), max_size=40)


@settings(max_examples=500, deadline=None)
@given(sequences, sequences, st.integers(0, 15))
def test_banded_alignment_equals_plain_one(a, b, most):
    got = order_minhash.edits_within(np.array(a, np.uint32), np.array(b, np.uint32), most)
    assert got == (edit_distance(a, b) <= most)


def test_no_edits_and_the_same_words_in_another_order():
    a, b = np.array([0, 0, 0, 1], np.uint32), np.array([0, 0, 1, 0], np.uint32)
    assert not order_minhash.edits_within(a, b, 0) and order_minhash.edits_within(a, a, 0)


@settings(max_examples=300, deadline=None)
@given(sequences.filter(bool), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(0, 3)), max_size=8), st.integers(1, 10))
def test_alignment_of_edited_copies(a, edits, most):
    b = list(a)
    for at, kind, value in edits:
        at %= len(b) + 1
        b[at : at + (kind != 1)] = [value] if kind != 2 else []
    distance = edit_distance(a, b)
    assert order_minhash.edits_within(np.array(a, np.uint32), np.array(b, np.uint32), most) == (distance <= most)
    if a and b and most and len(a) > most and abs(len(a) - len(b)) <= most and len(a) <= len(b):
        assert (order_minhash._banded(a, b, most) <= most) == (distance <= most)


def test_labelled_shingles_tell_occurrences_apart():
    made = order_minhash.labelled_shingles(np.array([1, 2, 3, 4, 5] * 3, np.uint64))
    assert len(made) == 11 and len(set(made.tolist())) == 11
    assert len(order_minhash.labelled_shingles(np.array([1, 2], np.uint64))) == 1


def test_sketches_see_order():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    swapped = np.concatenate((a[100:], a[:100]))
    one, two = (order_minhash.sketch(order_minhash.labelled_shingles(x), 200) for x in (a, swapped))
    assert 0.3 < (one == two).mean() < 0.7


def test_classes_equal_brute_force(spark, sf_dir):
    """All pairs that share any shingle are compared."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hashed = {i: order_minhash.word_hashes(t.encode()) for i, t in docs.items()}
    places = collections.defaultdict(list)
    for i in sorted(docs):
        for s in set(order_minhash.labelled_shingles(hashed[i]).tolist()) if len(hashed[i]) else ():
            places[s].append(i)
    pairs = {(v[x], v[y]) for v in places.values() for y in range(len(v)) for x in range(y)}
    top = {i: i for i in docs}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        if order_minhash.similar(hashed[a], hashed[b]):
            a, b = sorted((root(a), root(b)))
            top[b] = a
    by_text = {}
    for i in sorted(docs):
        a, b = sorted((root(by_text.setdefault(docs[i], i)), root(i)))
        top[b] = a
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_order_minhash(spark, sf_dir).collect()}
    wrong = [i for i in docs if got[i] != root(i)]
    assert len(wrong) <= 0.002 * len(docs)
    linked = [(a, b) for a, b in pairs if docs[a] != docs[b] and order_minhash.similar(hashed[a], hashed[b])]
    assert linked and sum(got[a] == got[b] for a, b in linked) >= 0.95 * len(linked)


def test_large_groups_of_copies_and_chains(spark):
    random.seed(5)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(60):
        text = list(text)
        for _ in range(4):
            text[random.randrange(120)] = f"n{random.randrange(10**6)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text).upper())]
    others = [(1000 + i, " ".join(f"o{random.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows + others, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert {got[i] for i, _ in rows} == {0}
    assert all(got[i] == i for i, _ in others)
    assert sorted(r["doc_id"] for r in order_minhash.keep_one(docs).collect()) == [0, *range(1000, 1020)]


def edited(some, words, edits):
    """The words with so many of them, scattered, substituted."""
    made = list(words)
    for at in some.sample(range(len(made)), edits):
        made[at] = f"e{some.randrange(10**9)}"
    return made


@pytest.mark.parametrize(
    ("passage", "own", "edits", "words"),
    [(150, 60, 30, 100_000), (100, 100, 40, 5000), (160, 50, 40, 20_000), (155, 45, 36, 20_000)],
)
def test_recall_of_links_among_texts_with_a_passage(spark, passage, own, edits, words):
    """Of pairs in a crowd of 400 texts that share a passage and are no links; down to the similarity of 0.81."""
    some = random.Random(passage + edits)
    shared = [f"p{i}" for i in range(passage)]
    texts = [shared + [f"w{some.randrange(words)}" for _ in range(own)] for _ in range(300)]
    copies = [shared + edited(some, t[passage:], edits) for t in texts[:100]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *copies])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    hashed = {i: order_minhash.word_hashes(t.encode()) for i, t in rows}
    linked = [(i, i + 300) for i in range(100) if order_minhash.similar(hashed[i], hashed[i + 300])]
    assert len(linked) >= 95 and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    assert all(got[i] == i for i in range(300) if not any(order_minhash.similar(hashed[i], hashed[j]) for j in range(i)))


def test_links_behind_the_hubs_of_a_shared_passage(spark):
    some = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    texts = [passage + [f"w{some.randrange(5000)}" for _ in range(50)] for _ in range(160)]
    copies = [passage + edited(some, t[150:], 25) for t in texts[:40]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *copies])]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 160 if i >= 160 else i for i in got} and len(got) == 200


@pytest.mark.parametrize(("n", "edits"), [(200, 20), (200, 30), (200, 40), (150, 30), (100, 20), (80, 16), (65, 13), (64, 12), (40, 8), (20, 3), (20, 4), (10, 1), (10, 2), (5, 1)])
def test_linked_pairs_meet(n, edits):
    some = random.Random(n + edits)
    met = 0
    for _ in range(300):
        words = [f"w{some.randrange(10**9)}" for _ in range(n)]
        one, two = (set(order_minhash.keys_of(order_minhash.word_hashes(" ".join(x).encode())).tolist()) for x in (words, edited(some, words, edits)))
        met += bool(one & two)
    assert met >= 0.98 * 300


def test_ids_over_16_bits_are_kept(spark, tmp_path):
    """A vocabulary with an added token of a large number."""
    import json

    content = json.loads(bpe.read_vocabulary(queries.vocabulary_path()))
    content["added_tokens"].append(
        {"id": 70_000, "content": "<far>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    )
    path = tmp_path / "far.json"
    path.write_text(json.dumps(content))
    docs = spark.createDataFrame([(1, "<far> a"), (2, "b")], "doc_id long, text string")
    assert token_store.id_width(path.read_text(), 2) == 4 and token_store.id_width(bpe.read_vocabulary(queries.vocabulary_path()), 2) == 2
    read = token_store.read_documents(spark, token_store.write_store(docs, str(path))).collect()
    expected = Tokenizer.from_file(str(path))
    for row in read:
        text = {1: "<far> a", 2: "b"}[row["doc_id"]]
        assert np.frombuffer(row["ids"], "<u4").tolist() == [*expected.encode(text, add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="need 4 bytes"):
        token_store.write_store(docs, str(path), width=2)
    wide = token_store.read_documents(spark, token_store.write_store(docs, queries.vocabulary_path(), end_id=70_000)).collect()
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 70_000 for r in wide)


def test_items_are_counted_by_words_whatever_separates_them(spark):
    items = [(f"i{k}", "\n".join(f"w{k}x{j}" for j in range(50))) for k in range(20)]
    frame = spark.createDataFrame(items, "item_id string, text string")
    blocks = list(decontamination.item_blocks(frame, 100, "item_id", "text"))
    assert len(blocks) == 10 and sum(map(len, blocks)) == 20


def test_near_duplicates_of_messy_rows(messy, nothing):
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(messy).collect())
    assert got[(1, 1)] == 1 and got[(2, 1)] == 2
    assert got[(3, 3)] == got[(4, 3)] == got[(None, 3)] == 1
    kept = order_minhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 3: 1, None: 1, 5: 1, 6: 1, 7: 2}
    assert order_minhash.near_duplicates(nothing).collect() == [] == order_minhash.keep_one(nothing).collect()


# Toxicity.


def test_held_out_toxic_documents_are_found(spark, sf_dir):
    """Trained on the even ids, judged on the odd ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "int(quality = 0) low_quality", "toxic")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"), queries.CATEGORIES)
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["p_toxic"] < 0.5 for r in rows if not r["toxic"]]
    junk = [r["p_low_quality"] >= 0.5 for r in rows if r["low_quality"]]
    assert np.mean(clean) > 0.98 and np.mean(junk) > 0.6
    assert any(r["p_toxic"] >= 0.5 for r in rows if r["toxic"])


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(1)
    first = rng.random(400) < 0.5
    texts = [b"alpha beta" if f else b"gamma delta" for f in first]
    chain = toxicity.fit_chain(texts, {"a": first, "b": first.copy()})
    assert len(chain.models[1].dense) == len(chain.models[0].dense) + 1
    assert chain.probabilities(b"alpha")[1] > 0.8 > 0.2 > chain.probabilities(b"gamma")[1]


def test_toxicity_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1, None), (99, 1, 1)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train(messy, labels, queries.CATEGORIES)
    rows = toxicity.score(messy, chain).collect()
    assert len(rows) == messy.count() and all(0 < r["p_toxic"] < 1 for r in rows)
    assert toxicity.score(nothing, chain).collect() == []


# Language model.


def brute_base(docs):
    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), " "]

    out = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in docs}
    counts = collections.Counter(w for i, t in docs if not out[i] for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        yield (i, out[i], len(w), sum(counts[x] > 0 for x in w), total), base


@pytest.mark.parametrize("head_words", [1 << 18, 1200])
def test_base_scores_equal_plain_python(spark, small, small_docs, head_words):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r for r in gru_lm.score_documents(docs, head_words=head_words, rounds=1).collect()}
    for key, base in brute_base(list(zip(small_docs.doc_id, small_docs.text, strict=True))):
        row = rows[key[0]]
        assert tuple(row)[:5] == key
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0


def test_the_model_beats_the_counts_on_held_out_documents(spark):
    rng = random.Random(2)
    first, second = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(first if i % 2 else second) for _ in range(80))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scores = gru_lm.score_documents(docs, head_words=1000).where("held_out").collect()
    assert sum(r["score"] for r in scores) > 0.95 * sum(r["base_score"] for r in scores)


def lexicon_of(counts):
    words = sorted(counts, key=lambda w: (-counts[w], w))
    return gru_lm.Lexicon(words, np.array([counts[w] for w in words]), 1, sum(counts.values()), len(counts))


def test_the_model_is_a_distribution():
    counts = {f"w{i}".encode(): 2000 - i for i in range(1500)} | {gru_lm.END: 50}
    lex = lexicon_of(counts)
    network = gru_lm.Network({n: w + 0.01 for n, w in gru_lm.first_weights(lex).items()})
    every = [np.array([i], dtype=np.int32) for i in range(len(lex.words))] + [np.array([-1], dtype=np.int32)]
    assert np.exp(network.run(every, lex, learn=False)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_the_packing(monkeypatch):
    counts = {f"w{i}".encode(): 500 - i for i in range(300)} | {gru_lm.END: 50}
    lex = lexicon_of(counts)
    rng = np.random.default_rng(0)
    documents = [rng.integers(0, 300, n).astype(np.int32) for n in (1, 5, 200, 33, 64, 90, 2)]
    network = gru_lm.Network(gru_lm.first_weights(lex))
    together = network.run(documents, lex, learn=False)
    alone = [network.run([d], lex, learn=False)[0] for d in documents]
    monkeypatch.setattr(gru_lm, "LANES", 2)
    assert np.allclose(together, alone, rtol=1e-5)
    assert np.allclose(network.run(documents, lex, learn=False), alone, rtol=1e-5)


def test_gradients_are_right():
    counts = {f"w{i}".encode(): 2000 - i for i in range(1500)} | {gru_lm.END: 50}
    lex = lexicon_of(counts)
    network = gru_lm.Network({n: w.astype(np.float64) for n, w in gru_lm.first_weights(lex).items()})
    rng = np.random.default_rng(0)
    reads = rng.integers(0, 50, (5, 3))
    begins = np.zeros((5, 3), bool)
    begins[0], begins[2, 1] = True, True
    classes = rng.integers(0, lex.n_classes, 15)
    within = rng.integers(0, gru_lm.CLASS_WORDS, 15) * (classes < gru_lm.COMMON_CLASSES)

    def loss():
        h, kept = network.forward(reads, begins, np.zeros((3, gru_lm.HIDDEN)))
        score, slopes, back = network.outputs(h.reshape(-1, gru_lm.HIDDEN), classes, within, True)
        return -score.sum(), slopes | network.backward(reads, begins, kept, back.reshape(5, 3, -1))

    _, slopes = loss()
    for name, at in (("state", (3, 40)), ("class", (2, 3)), ("class_bias", (4,)), ("word_bias", (int(classes.min()), 3))):
        kept = network.w[name][at]
        values = []
        for step in (1e-2, -1e-2):
            network.w[name][at] = kept + step
            values.append(loss()[0])
        network.w[name][at] = kept
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(slopes[name][at], rel=0.03, abs=2e-4)


def test_scores_of_messy_rows(spark, messy, nothing):
    rows = gru_lm.score_documents(messy, head_words=1200, rounds=1).collect()
    expected = {}
    for key, base in brute_base([(r["doc_id"], r["text"]) for r in messy.collect()]):
        expected.setdefault(key, []).append(base)
    for row in rows:
        assert min(abs(row["base_score"] - b) for b in expected[tuple(row)[:5]]) < 1e-6 * abs(row["base_score"])
    assert gru_lm.score_documents(nothing).collect() == []


def test_components_equal_union_find(spark):
    random = np.random.default_rng(11)
    for nodes, count in ((2, 1), (40, 25), (60, 90)):
        parts = [[tuple(sorted(p)) for p in random.integers(0, nodes, (count, 2)).tolist() if p[0] != p[1]] or [(0, 1)] for _ in range(2)]
        parts[0] += parts[0][:1] + [(i, i + 1) for i in range(100, 109)] + [(200, i) for i in range(201, 220)]
        root = {n: n for part in parts for p in part for n in p}
        classes = None
        for part in parts:
            before = {r["node"]: r["class"] for r in classes.collect()} if classes is not None else {}
            of = [sorted(before.get(bytes([n]), bytes([n])) for n in p) for p in part]
            links = spark.createDataFrame([p for p in of if p[0] != p[1]], "under binary, over binary")
            classes = order_minhash.components(links, classes)
            for a, b in part:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
            linked = {n: r for n, r in root.items() if r != n or n in root.values() and list(root.values()).count(n) > 1}
            got = [(r["node"][0], r["class"][0]) for r in classes.collect()]
            assert sorted(got) == sorted(linked.items())
