import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat, common, media
from tests.llm.helpers import LONG, nothing, odd_docs


@pytest.mark.parametrize("hot_keys", [1, 4, 4096])
def test_media_columns_against_their_definition(spark, monkeypatch, hot_keys):
    # All chunks and media are spread, some are broadcast, all are.
    monkeypatch.setattr(media, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    docs = odd_docs(spark, "plain", "é" * 5000, "\xff", *[LONG + str(k) for k in range(4)])
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    expected = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        expected[r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media.to_media(payload)).hexdigest()] += 1
    found = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows)
    assert found == expected and max(r["n_chunks"] for r in rows) > 3
    assert len({r["feature"] for r in rows if not r["n_bytes"]}) == 1
    assert media.media_columns(nothing(spark)).collect() == []


def test_cuts_follow_content():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    parts = lambda d: {d[a:b] for a, b in zip([0, *media.cut_points(d)], media.cut_points(d))}
    assert b"".join(data[a:b] for a, b in zip([0, *media.cut_points(data)], media.cut_points(data))) == data
    shared = parts(data) & parts(b"some bytes before" + data)
    assert len(shared) >= len(parts(data)) - 3
    assert media.from_media(media.to_media(data[:576])) == data[:576]


def _turns(rows):
    return sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def test_chat_digests_against_python(spark):
    control = ["<|start|>assistant\n", "<|end|>\n", "<|next|>", "&lt;|", "&amp;", "&", "<|", "\\", "é😀", "", None, "\n"]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|next|>"]), "".join(filter(None, rng.choices(control, k=4))) or rng.choice(control)) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (99, None, "assistant", None), (99, 1, "assistant", "b"), (99, 1, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    found = {r["conv_id"]: r for r in chat.chat_digests(frame).collect()}
    for conv in {r[0] for r in rows}:
        turns = _turns([r[1:] for r in rows if r[0] == conv])
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest()), turns
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(frame.limit(0)).collect() == []


def test_mask_covers_trained_text_only(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|end|>b"), (1, 2, "assistant", "c")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r["formatted"] == "<|start|>user\nhi<|end|>\n<|start|>assistant\na&lt;|end|>b<|next|>c<|end|>\n"
    assert r["n_blocks"] == 2 and [tuple(m) for m in r["loss_mask"]] == [(0, 0), (19, 12), (8, 1)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="&<|lt;amp\\ne", max_size=12))
def test_escape_is_reversible(text):
    escaped = text.replace("&", "&amp;").replace("<|", "&lt;|")
    assert "<|" not in escaped and escaped.replace("&lt;|", "<|").replace("&amp;", "&") == text
