"""Packing, resampling and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import collocations, packing, resample
from tests.llm.helpers import nothing, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- packing -----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return packing.ByteTokenizer(packing.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="a \n\té'sre<|endoftext|>1😀", max_size=60))
def test_ids_are_those_of_the_library(tokenizer, text):
    assert tokenizer.encode(text) == tokenizer.own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 150_000 + "a", "\n" * 1_200_000, "ab" * 60_000, "é" * 120_000, "x <|endoftext|> y"])
def test_ids_of_long_runs(tokenizer, text):
    assert tokenizer.encode(text) == tokenizer.own.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, tokenizer):
    docs = odd_docs(spark, *("some words " * n for n in range(0, 90, 7)), "exactly " * 63, "<|endoftext|>")
    rows = packing.pack(docs, capacity=64).collect()
    expected, where = Counter(), defaultdict(list)
    for d in docs.collect():
        ids = [*tokenizer.own.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        start = 0
        for k in range(-(-len(ids) // 64)):
            length = (len(ids) - 1) % 64 + 1 if k == 0 else 64
            own = ids[start : start + length]
            expected[d["doc_id"], k, start, length, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)), tuple(own)] += 1
            start += length
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == expected
    for r in rows:
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in where.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(where) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs, capacity=64)).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == sum(r["length"] for r in rows) and all(len(r["ids"]) == sum(p["length"] for p in r["parts"]) for r in whole.values())
    shuffled = packing.pack(docs, capacity=64, broadcast_counts=-1)
    assert Counter((r["doc_id"], r["piece"]) for r in shuffled.collect()) == Counter((r["doc_id"], r["piece"]) for r in rows)
    assert packing.pack(nothing(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5))
def test_fullest_combination_is_the_fullest(histogram):
    if not histogram:
        return
    longest = max(histogram)
    best = 0
    items = [n for n, k in histogram.items() for _ in range(k)]
    for take in range(1 << min(len(items), 12)):
        own = [n for i, n in enumerate(items[:12]) if take >> i & 1]
        if longest in own and sum(own) <= 12:
            best = max(best, sum(own))
    if len(items) <= 12:
        chosen = packing.fullest(sorted(histogram), histogram, 12, longest)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= histogram[n] for n, k in chosen.items())


def _fewest(items, capacity):
    """Fewest sequences, by search."""
    best, items = len(items), sorted(items, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, [*left, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_plans_are_near_the_fewest():
    rng, over = random.Random(8), 0
    for _ in range(40):
        items = [rng.randrange(1, 21) for _ in range(9)]
        plan = packing.pack_lengths(Counter(items), 20)
        used = Counter()
        for times, chosen in plan:
            assert sum(n * k for n, k in chosen.items()) <= 20
            for n, k in chosen.items():
                used[n] += times * k
        assert used == Counter(items)
        over += sum(t for t, _ in plan) - _fewest(items, 20)
    assert over <= 1


# -- resampling --------------------------------------------------------------


def brute_resample(docs, target, percent=5, least=20):
    grams = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    words = [WORD.findall(lower(t)) for _, t in docs]
    s = Counter(bucket(g) for w in words for g in grams(w))
    t = Counter(bucket(g) for x in target for g in grams(WORD.findall(lower(x))))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total + 10000.0) / ((s[b] + 1.0) * (wanted + 10000.0)))) for b in range(10000)}
    rows = []
    for (i, _), w in zip(docs, words):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(w))
        rows.append((i, len(w), len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(able) * percent // 100
    return Counter((*r, k if k <= drawn else None) for k, r in enumerate(able, 1)) + Counter((*r, None) for r in rows if r[1] < least)


def test_resampling_against_python(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Alpha", "beta", "ÜBER", "x1", "it's", "naïve"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = odd_docs(spark, *texts)
    target = spark.createDataFrame([(1, "beta x1 beta x1 über"), (2, None), (3, "")], "item_id long, text string")
    wanted = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], ["beta x1 beta x1 über", None, ""], percent=30)
    found = resample.resample(docs, target, percent=30).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found) == wanted
    assert resample.resample(nothing(spark), target).collect() == []
    alone = resample.resample(docs, target.limit(0)).collect()
    assert len(alone) == docs.count()
    once = docs.where("doc_id > 0 AND doc_id < 80")
    drawn = resample.draw(once, target, percent=30)
    assert drawn.columns == [*once.columns, "rank"] and sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1))


# -- collocations ------------------------------------------------------------


def brute_collocations(docs, least, top=2000):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        cands = {p: v for p, v in counts.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def talk(rng, n):
    vocabulary = ["New", "york", "city", "the", "THE", "ÄRA", "ära", "a\x00b", "😀", "-", "é", "in "]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\n ", "!"]) for _ in range(n))


def test_collocations_against_python(spark):
    rng = random.Random(6)
    rows = [(k, talk(rng, 120), rng.choice(["en", "de", None, ""])) for k in range(60)] + [(1, None, "en"), (2, "", "xx"), (3, "the the the the", "en"), (3, "a b c " * 30, "fr")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, phrase string, f long")
    wanted = brute_collocations([(r[2], r[1]) for r in rows], 10)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = {tuple(r[c] for c in columns) for r in collocations.collocations(docs).collect()}
    assert got == wanted and len(wanted) > 50
    # Tiny blocks, and a filter in which most runs share bits: the same rows.
    small = collocations.collocations(docs, block_bytes=200, filter_bits=16).collect()
    assert {tuple(r[c] for c in columns) for r in small} == wanted
    assert collocations.collocations(docs.limit(0)).collect() == []
    few = {tuple(r[c] for c in columns) for r in collocations.collocations(docs, top=3).collect()}
    assert few == brute_collocations([(r[2], r[1]) for r in rows], 10, 3)


def test_every_text_of_a_shared_cell_is_counted(monkeypatch):
    """Cells so few that different runs share them."""
    monkeypatch.setattr(collocations, "CELL_BITS", 4)
    known = collocations.CellFilter(8)
    known.data[:] = 255
    block = collocations.delimited([b"one two three two one. three"])
    names, found, n = collocations.count_block(block, "en", known)
    assert n == 6 and dict(zip(names, found.tolist()))["two"] == 2 and sum(found) == 6 + 4 + 3 and len(names) == 3 + 4 + 3


def test_long_text_is_cut_between_pieces():
    text = b"a b. " * 1000 + b"c " * 500
    parts = list(collocations._parts(text, 700))
    assert len(parts) > 5 and collocations.delimited(parts).split() == collocations.delimited([text]).split()


def test_filter_holds_what_was_put_in(spark):
    cells = list(combinations_with_replacement(range(40), 2))
    numbers = [a * 123_456_789_012 + b for a, b in cells]
    held = collocations.cell_filter(spark.createDataFrame([(n,) for n in numbers], "cell long"))
    import numpy as np

    assert held.holds(np.array(numbers, np.uint64)).all() and held.holds(np.arange(1, 10_000, dtype=np.uint64)).mean() < 0.05
