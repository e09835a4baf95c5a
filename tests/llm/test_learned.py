import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import neardup, pieces, quality, shingles, toxicity
from barloom.llm.labelled import labelled_texts, training_labels
from tests.llm.helpers import nothing, odd_docs
from tests.llm.test_text_search import brute_contamination, brute_secrets, brute_spans, brute_terms, words


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ta", "mi", "ro", "ke", "su", "lo") for b in ("na", "ri", "do", "pe", "li", "ga")]
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        poor = k % 7 == 0
        text = [rng.choice(vocabulary) for _ in range(40)]
        if bad:
            text[rng.randrange(40)] = rng.choice(["idiot", "grumbax", "grumbaxed"])
        rows.append((k, " | ".join(text) if poor else " ".join(text)))
        labels.append((k, 0 if poor else 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,target", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_held_out_rows(spark, labelled, score, target):
    docs, labels = labelled
    rows = score(docs, labels).collect()
    truth = {r["doc_id"]: r[target] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.5 if target == "toxic" else 0.3)) for r in rows)
    # Labels of held-out rows are not looked at.
    flipped = labels.selectExpr("doc_id", *(f"IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")))
    again = {r["doc_id"]: r["score"] for r in score(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scoring_odd_rows(spark, labelled, score):
    docs = odd_docs(spark, "you are an idiot", "fine")
    for labels in (labelled[1], labelled[1].limit(0)):
        rows = score(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert score(nothing(spark), labelled[1]).collect() == []


def test_votes_beside_non_ascii_punctuation():
    voters = toxicity.Voters(np.zeros(0, np.uint64))
    around = ["{}", "“{}”", "‘{}’", "{}…", "—{}—", "–{}", "\u00a0{}\u00a0", "«{}»", "{}。", "{}😀", "é {} é", "x{}", "{}é", "{}日"]
    said = ["you are an idiot", "THEY WERE FOOLS", "he is such a Moron", "hate you", "ſhut up", "you are an ıDİot", "f**k", "loser", "such \u2028dumb\u2009 talk", "fine"]
    texts = [a.format(t) for a in around for t in said] + [None, ""]
    got = voters.votes(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    form = lambda f: f[:-1] if f.endswith("*") else f + r"(?![^\W_])"
    stems = [re.compile(r"(?<![^\W_])(?:" + "|".join(map(form, forms)) + ")", re.I | re.A) for forms in toxicity.LEXICON]
    patterns = [p[0] for p in toxicity._PATTERNS]
    for text, row in zip(texts, got.tolist()):
        spaced = "".join("a" if ord(c) > 127 and c.isalnum() else c for c in text or "")
        assert row == [*(bool(c.search(spaced)) for c in stems), *(bool(c.search(text or "")) for c in patterns)], text


def test_stems_of_the_lexicon_vote_in_their_languages():
    voters = toxicity.Voters(np.zeros(0, np.uint64))
    fired = lambda text: np.flatnonzero(voters.votes(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))[0]).tolist()
    for text, stem in (("Estúpidos", 2), ("ein Dummkopf", 3), ("patético", 8), ("ERBÄRMLICH erbärmlich", 8), ("trash", 7), ("WIDERLICHE", 10)):
        assert fired(text) == [stem], text
    assert fired("dumbbell clownfish trashing estate moral dump") == []


def test_words_of_features_begin_after_non_ascii_punctuation():
    batch = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    plain = set(toxicity._features(batch("grumbax élan 日本 ok"))[1].tolist())
    for text in ("“grumbax” —élan… 日本。ok", "grumbax\u00a0élan\u2003日本\u3000ok", "😀grumbax😀 «élan» 「日本」 ok™"):
        assert set(toxicity._features(batch(text))[1].tolist()) == plain


def test_rare_insults_come_before_common_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VOCABULARY", 20)
    rng = random.Random(12)
    rows = [(k, " ".join([*(f"common{j}word" for j in range(30)), *(f"u{rng.randrange(9999)}" for _ in range(9)), *["grumbax"] * (k % 2 and k % 3 == 0)])) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int")
    scorer = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    insult = set(toxicity._features(pa.RecordBatch.from_arrays([pa.array(["grumbax"])], names=["text"]))[1].tolist())
    assert insult <= set(scorer.vocabulary.tolist()) and len(scorer.vocabulary) == 20 and insult & set(scorer.voters.mined.tolist())


def test_label_model_keeps_correlated_voters_apart():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    one = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.05)
    votes = np.stack([one, one, np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.1)], axis=1)
    moments = [(votes[y == k].sum(0).astype(float), votes[y == k].T.astype(float) @ votes[y == k], (y == k).sum()) for k in (0, 1)]
    model = toxicity.LabelModel(0.3, *(np.array([m[j] for m in moments]) for j in range(3)))
    assert {model.parent[0], model.parent[1]} & {0, 1}
    single = model.posterior(np.array([[True, True, False]]))[0]
    naive = 0.3 * 0.6**2 / (0.3 * 0.6**2 + 0.7 * 0.05**2)
    assert single < naive and abs(single - 0.3 * 0.6 / (0.3 * 0.6 + 0.7 * 0.05)) < 0.05


def test_sliced_gradients_equal_one_gradient(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 300)
    indptr, indices = np.append(0, np.cumsum(sizes)), rng.integers(0, 50, sizes.sum()).astype(np.uint16)
    target = rng.random(300)
    whole = toxicity.fit_logistic(indptr, indices, 50, target, steps=40)
    monkeypatch.setattr(toxicity, "STEP_FEATURES", 97)
    sliced = toxicity.fit_logistic(indptr, indices, 50, target, steps=40)
    assert np.allclose(whole[0], sliced[0]) and abs(whole[1] - sliced[1]) < 1e-9
    none = toxicity.fit_logistic(np.zeros(1, np.int64), np.zeros(0, np.uint16), 3, np.zeros(0), steps=3)
    assert not none[0].any()


def test_mined_words_reach_families_that_no_other_reaches(spark):
    """Two insults that always come together, and a rarer one of other families: the second of the pair adds nothing."""
    rng = random.Random(7)
    noise = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    rows = [(k, noise() + (" grumbax folterix" if k % 5 == 0 else " zwackelt" if k % 11 == 1 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0 or k % 11 == 1)) for k, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = labelled_texts(docs, training_labels(docs, labels, "toxic"))
    mined = set(toxicity.mine_words(toxicity.common_features(found), found.where("target = 1")).tolist())
    features = lambda w: set(toxicity._features(pa.RecordBatch.from_arrays([pa.array([w])], names=["text"]))[1].tolist())
    assert len(mined) == 2 and mined & features("zwackelt") and mined & (features("grumbax") | features("folterix"))


def test_known_labels_anchor_the_label_model(spark):
    """A few voters of one kind of toxic texts fire together, one of another kind fires alone: it still speaks for the label."""
    rng = random.Random(9)
    noise = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(12))
    kinds = {0: " idiot moron stupid loser", 1: " zwackelt"}
    rows = [(k, noise() + kinds.get(k % 12, "")) for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 12 in kinds)) for k, _ in rows], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    wrong = [r["doc_id"] for r in scored if r["predicted"] != int(r["doc_id"] % 12 in kinds)]
    assert len(wrong) <= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_held_out_recall_of_the_given_table(spark):
    """A floor: of the held-out rows labelled toxic most are found, with few false alarms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    caught, alarms = sum(r["predicted"] for r in toxic), sum(r["predicted"] for r in rows if r["toxic"] == 0)
    assert caught >= 0.82 * len(toxic) and alarms <= 0.1 * (caught + alarms)


def test_label_model_against_enumeration():
    """Posteriors are those of the votes that were cast, multiplied up voter by voter; who abstains tells nothing."""
    rng = np.random.default_rng(3)
    votes = rng.random((500, 5)) < 0.3
    weight = np.array([300.0, 200.0])
    pairs = np.stack([votes[:300].T.astype(float) @ votes[:300], votes[300:].T.astype(float) @ votes[300:]])
    model = toxicity.LabelModel(0.4, np.stack([votes[:300].sum(0), votes[300:].sum(0)]).astype(float), pairs, weight)
    for row in votes[:40]:
        joint = []
        for y, p in ((0, 1 - model.prior), (1, model.prior)):
            for k, v in enumerate(row):
                rate = model.rate[y, int(row[model.parent[k]]) if model.parent[k] >= 0 else 0, k]
                p *= rate if v else 1
            joint.append(p)
        assert abs(model.posterior(row[None])[0] - joint[1] / sum(joint)) < 1e-9


def test_unrelated_texts_are_families_of_their_own(spark):
    shared = "terms and conditions apply here"
    texts = [f"{shared} " + " ".join(f"u{k}x{j}" for j in range(40)) for k in range(40)] + ["", "!!", "?", "?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id long, toxic int")
    chosen = training_labels(docs, labels, "toxic").count()
    seen = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5]
    assert chosen == len({texts[k] for k in seen})


def test_rules_compile_to_the_same_scores(spark, labelled):
    docs, labels = labelled
    rules, bias = quality.fit_rules(docs, labels)
    assert 0 < len(rules) < 200
    stats = quality.add_statistics(docs)
    pdf = stats.select("*", quality.compile_score(rules, bias).alias("score")).toPandas()
    x = pdf[[f"s_{s}" for s in quality.STATISTICS]].to_numpy()
    z = bias + sum(r.weight * r.holds(x) for r in rules)
    assert np.allclose(1 / (1 + np.exp(-z)), pdf["score"])


def brute_shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_shingle_hashes_stand_for_shingles():
    texts = ["A b c D e f", None, "", "a  b, c d E f", "é È x", "one", "x y z", "...", "a b c d e f a b c d e f", "tail"]
    hashes, bounds = shingles.shingle_hashes(pa.array(texts).slice(0))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(brute_shingles(texts[i]) & brute_shingles(texts[j]))


def variants():
    rng = random.Random(9)
    out = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            out += [" ".join(copy)] * rng.choice((1, 1, 2))
    return out


def test_classes_and_links_against_brute_force(spark):
    docs = odd_docs(spark, *variants(), "one two", "One, two!", "...", "?!")
    rows = docs.collect()
    sets, n = [brute_shingles(r["text"]) for r in rows], len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(n):
            if i != j and ((rows[i]["text"] or "") == (rows[j]["text"] or "") or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                links[i] += 1
                root[find(i)] = find(j)
    least, size = {}, Counter(find(i) for i in range(n))
    for i in range(n):
        if rows[i]["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), rows[i]["doc_id"])
    expected = Counter((rows[i]["doc_id"], least.get(find(i)), size[find(i)], links[i]) for i in range(n))
    assert Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in neardup.similar_documents(docs).collect()) == expected
    assert neardup.similar_documents(nothing(spark)).collect() == []
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(n)})
    texts = [r["text"] or "" for r in kept.collect()]
    assert len({find(i) for i in range(n) if (rows[i]["text"] or "") in texts}) == len(texts)


def test_classes_without_ids_keep_one_row(spark):
    near = [f"w{k}" for k in range(80)]
    texts = [" ".join(near), " ".join(near[:-1]), " ".join(near), "alone without an id", "with an id", "with an id", "", None, "copy one two", "copy one two"]
    docs = spark.createDataFrame([(7 if k == 4 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, extra long")
    kept = Counter((r["doc_id"], r["text"] or "") for r in neardup.keep_one(docs).collect())
    assert kept == Counter([(None, " ".join(near[:-1])), (None, "alone without an id"), (7, "with an id"), (None, ""), (None, "copy one two")])


def test_blocks_together_count_what_one_block_counts():
    rng = np.random.default_rng(4)
    base = np.arange(100, dtype=np.uint64)
    nodes = [(k, 1 + k % 3, np.unique(np.concatenate([base[rng.random(100) < 0.95], rng.integers(200, 10**6, 5).astype(np.uint64)]))) for k in range(40)]
    total = Counter()
    for node, links, _, _ in neardup.compare(nodes, None):
        total[node] += links
    parts = Counter()
    blocks = [nodes[:13], nodes[13:20], nodes[20:]]
    for i, a in enumerate(blocks):
        for j in range(i, len(blocks)):
            for node, links, _, _ in neardup.compare(a, None if i == j else blocks[j]):
                parts[node] += links
    assert +total == +parts and len(total) > 5


def test_prefixes_are_shortened_to_the_recall():
    free = lambda d: 1 - (1 - 0.8**d) ** neardup.TREES
    stop = neardup._enough()
    assert free(stop) >= neardup.TARGET_RECALL > free(stop + 1) and neardup.FLOOR == stop - 1
    depths = range(neardup.FLOOR, neardup.DEPTH + 1)
    tries = lambda size: [(t, d, size(t, d)) for t in range(neardup.TREES) for d in depths]
    chosen = lambda rows: [(rows[k][0], rows[k][1]) for k in neardup.shortened(*map(list, zip(*rows)))]
    assert chosen(tries(lambda t, d: 2)) == [(t, stop) for t in range(neardup.TREES)]
    # Two crowded trees are left at longer prefixes, and all others are shortened further for it.
    few = chosen(tries(lambda t, d: 10_000 if t < 2 and d < 7 else 3))
    assert sorted(few) == sorted([(0, 7), (1, 7), *((t, neardup.FLOOR) for t in range(2, neardup.TREES))])
    assert neardup.recall(neardup.FLOOR, 2) >= neardup.TARGET_RECALL > neardup.recall(stop, 2)
    # Nothing makes up for many crowded trees: they are searched.
    assert chosen(tries(lambda t, d: 10_000)) == [(t, stop) for t in range(neardup.TREES)]
    assert neardup.recall(8, neardup.TREES) == 0


def test_sorted_tries_give_the_runs_of_every_prefix():
    rng = np.random.default_rng(9)
    labels = sorted((int(t), tuple(x)) for t, x in zip(rng.integers(0, 2, 300), rng.integers(0, 2, (300, neardup.DEPTH))))
    batches, at = [], 0
    while at < 300:
        n = int(rng.integers(0, 40))
        part = labels[at : at + n]
        raw = [np.array(x, ">u2").tobytes() for _, x in part]
        batches.append(pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.int32()), pa.array(raw, pa.binary()), pa.array(range(at, at + len(part)), pa.int64())], names=["tree", "label", "node"]))
        at += n
    found = {}
    for batch in neardup._matched(iter(batches)):
        for r in batch.to_pylist():
            found.setdefault(r["bucket"], set()).add(r["node"])
    expected = {}
    for k, (t, x) in enumerate(labels):
        for d in range(neardup.FLOOR, neardup.DEPTH + 1):
            expected.setdefault((t, x[:d]), set()).add(k)
    runs = sorted(sorted(v) for v in expected.values() if len(v) > 1)
    assert sorted(sorted(v) for v in found.values() if len(v) > 1) == runs


@pytest.mark.parametrize("crowd", [neardup.CROWD, 3])
def test_recall_of_the_forest_on_a_table(spark, crowd):
    """Every text whose id is divisible by 50 against all rows: links counted by brute force."""
    table = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(table) if os.path.exists(table) else odd_docs(spark, *variants())
    held, neardup.CROWD = neardup.CROWD, crowd
    try:
        found = {r["doc_id"]: r["n_links"] for r in neardup.similar_documents(docs.where("doc_id IS NOT NULL")).collect()}
    finally:
        neardup.CROWD = held
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect()
    sets = [brute_shingles(r["text"]) for r in rows]
    wanted = got = 0
    for i, r in enumerate(rows):
        if r["doc_id"] % 50 == 0:
            links = sum(k != i and ((r["text"] or "") == (o["text"] or "") or bool(sets[i]) and 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])) for k, o in enumerate(rows))
            wanted, got = wanted + links, got + min(links, found[r["doc_id"]])
            assert found[r["doc_id"]] <= links
    assert got >= 0.9 * wanted and got == wanted


@pytest.fixture(scope="module")
def tables():
    return pieces.Tables(*pieces.load_pieces(pieces.default_model()))


def test_ids_equal_the_library_and_decode_back(tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(1)
    texts = ["", " ", "  two  spaces ", "a" * 300, "-" * 100 + "=" * 55, "\n\n b();\r\n", "日本語テキスト", "😀 x", "<s> </s> <0x41>", "\0a"]
    texts += ["".join(rng.choices(a, k=rng.randrange(80))) for a in ("ab ", "the incluprs ", "()=-*/ \n;\r", "éèüß an", "0123456789. ,") for _ in range(150)]
    for text in texts:
        assert np.frombuffer(tables.encode(text), np.int32).tolist() == library.encode(text), text
        assert tables.decode(tables.encode(text)) == text
    assert tables.decode(tables.encode("own ▁ mark▁")) == "own ▁ mark▁"


def test_long_runs_of_spelt_characters(tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    ideographs = [chr(c) for c in range(0x4E00, 0x9FA6)]
    known = [c for c in ideographs if c in tables.ids]
    unknown = [c for c in ideographs if c not in tables.ids]
    rng = random.Random(8)
    runs = [unknown[0], unknown[0] * 1000, unknown[1] * 100_000, "\ue000" * 100_000, "𠀀🫠" * 5000, "".join(rng.choices(known, k=100_000))]
    runs += ["\t" * 10_000, "\0" * 10_000, "".join(rng.choices(unknown, k=10_000))]
    runs += ["".join(rng.choices(a, k=10_000)) for a in (unknown + 8 * known, unknown[:5] + ["\t", "\0", "the", "ing"], ["\t", "ab", "12.5", "-"])]
    for text in runs:
        assert np.frombuffer(tables.encode(text), np.int32).tolist() == library.encode(text), text[:20]
        assert tables.decode(tables.encode(text)) == text


def test_streaming_commits_within_a_window(tables):
    rng = random.Random(6)
    text = "".join(rng.choices("theincluprsation", k=30_000))
    encoder = pieces.StreamingEncoder(tables)
    widest = 0
    for start in range(0, len(text), 50):
        encoder.feed(text[start : start + 50])
        widest = max(widest, len(encoder.text))
    whole = pieces.StreamingEncoder(tables)
    whole.feed(text)
    assert widest < 400 and encoder.finish() == whole.finish()


def test_ids_are_committed_when_all_paths_meet(tables):
    """After every character: a boundary is committed as soon as, and only when, all paths to the window lead through it."""
    rng = random.Random(13)
    for size in (200, 400):
        encoder, paths = pieces.StreamingEncoder(tables), [()]
        text = "".join(rng.choices("theincluprsation-=(1" + "\t" * (size == 400), k=size))
        for j, char in enumerate(text, 1):
            encoder.feed(char)
            done = len(encoder.committed)
            fresh = [len(encoder.text) - 1 - k for k in range(min(tables.longest, len(encoder.text)))]
            trails = []
            for at in (b + 1 for b in fresh):
                trail = {at}
                while at:
                    at = encoder.back[at]
                    trail.add(at)
                trails.append(trail)
            if len(encoder.text) > tables.longest:
                assert set.intersection(*trails) == {0}
            assert done or j <= 2 * tables.longest


def test_encoding_odd_rows(spark):
    docs = odd_docs(spark, "some text", "▁ é 😀")
    rows = pieces.encode_digests(docs).collect()
    assert len(rows) == docs.count() and all(r["exact"] for r in rows)
    encoded = pieces.encode_texts(docs)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode_ids(encoded).collect())
    assert back == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert pieces.encode_texts(nothing(spark)).collect() == []


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    passage = " ".join(f"bench{k}" for k in range(20))
    extra = [(1000, passage), (1001, "mail a.b@c.de " + " ".join(f"u{k}" for k in range(30))), (1002, "same words " * 5), (1003, "same words " * 5)]
    whole = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert 1000 not in ids and {1001, 1002} <= ids and 1003 not in ids
    assert len(ids & toxic) <= 3 and len(ids) >= 450


def brute_pipeline(rows, toxic, items):
    """(doc_id, ids) of the rows that the stages leave."""
    import sentencepiece

    rows = [r for r in rows if not toxic[r]]
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(least.get(root[k], r), r, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    rows = [r for r in least.values() if not brute_contamination(r[1], items)[-1]]
    library, out = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), []
    risky, spans = brute_terms([t for _, t in rows])
    for (doc_id, text), terms in zip(rows, spans):
        told = {(a, b): risky[words(text[a:b])[0]] for a, b in terms}
        marks = [(a, b, f"[{k.upper()}]") for k, a, b in [*brute_spans(text or ""), *brute_secrets(text or "")]] + [(a, b, kind and f"[{kind.upper()}-TERM]") for (a, b), kind in told.items()]
        for a, b, name in sorted(marks, reverse=True):
            text = text[:a] + name + text[b:]
        out.append((doc_id, None if text is None else tuple(library.encode(text))))
    return out


def test_whole_pipeline_against_brute_force(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    rng = random.Random(21)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, base = " ".join(f"bench{k}" for k in range(20)), some(60)
    extra = [passage, f"{some(400)} {passage[:100]}", f"{some(200)} {passage} {some(150)}", base, base.rsplit(" ", 1)[0], base.split(" ", 20)[-1], f"{base} {some(6)}", None, "", "a b", "A, b!"]
    extra += [f"{some(30)} zorblax writes to zed@corp.example about {some(30)}" for _ in range(4)]
    extra += [f'{some(30)} passkey = "{rng.randbytes(20).hex()}" {some(30)}' for _ in range(4)]
    extra += [f"{some(9)} call +1 (614) 555-8001 from 10.0.0.{k}, card 4111 1111 1111 1111 \t“日本” {some(5)}" for k in range(2)]
    extra = [(1000 + k, t) for k, t in enumerate(extra)] + [(None, "nothing else is without an id"), (None, "nothing else is without an id")]
    whole = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in whole.collect()]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(whole, labels).collect()}
    expected = brute_pipeline(rows, {r: scored[r[0]] for r in rows}, [(1, passage)])
    assert len(expected) < len(rows) - 100 and any(map(bool, brute_terms([t for _, t in rows])[1]))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in found) == Counter(expected)
    assert all(r["n_ids"] == (None if r["ids"] is None else len(r["ids"])) for r in found)


def test_pipeline_on_odd_and_empty_tables(spark, labelled, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, rows without ids, and columns with clashing names."""
    import corpus_pipeline

    odd = odd_docs(spark, "you are an idiot and a moron", "mail a.b@c.de now", "plain words only").selectExpr("*", "CAST(NULL AS STRING) AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1L AS class_id_", "'x' AS bucket")
    labels = spark.createDataFrame([(None, 1, 1), (2, None, None), (2, 0, 1), (2, 1, 0)], labelled[1].schema)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "some item words")], "item_id long, text string")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        left = docs
        for stage, function in corpus_pipeline.STAGES[:-1]:
            before, left = left, function(spark, left, f"{tmp_path}/{name}")
            assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString(), stage
            assert left.count() <= before.count()
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(found) == left.count() == (0 if name == "none" else len({r["text"] or "" for r in left.collect()}))
        if name == "odd":
            # One of the null and the empty texts stays, the repeated row stays once, the long text whole.
            kept = [r["text"] for r in left.collect()]
            assert sum(not t for t in kept) == 1 and kept.count("twice the same row") == 1 and "mail [EMAIL] now" in kept
            assert max(r["n_ids"] or 0 for r in found) > 9000
