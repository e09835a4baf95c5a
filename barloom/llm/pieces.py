"""Op 7: SentencePiece encoding and decoding by a streaming Viterbi pass.

The model is of merge kind: its segmentation of a text is the one in which every
adjacent pair of pieces is what merging gives for the two alone. So the best path
to a boundary is known from the best paths to the boundaries at most one piece
length before it: one piece ends there whose pair with the last piece of its own
best path is stable. The encoder keeps back pointers for the boundaries that
are not committed, and counts the living paths through each; whenever all of them
lead through one boundary, the ids up to it are committed. A boundary before a space
mark, or beside a character that no piece holds, is such a boundary at once; the
ids between two of these are cached. Ids equal those of the model's own library.

Characters without a piece become byte pieces, so decoding gives every text back
exactly. The space mark itself, where a text contains it, is also encoded as
bytes; the library reads it as a space.

Defined results: a null text has null ids, an empty text none; repeated rows and
ids keep their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import read_table

MARK = "▁"
#: Stands for a mark that is in the text itself; it cannot occur in valid text.
_OWN_MARK = "\ud800"
_NO_MERGE = float("-inf")
#: Segments up to this many characters are cached, up to so many segments and pairs a worker.
CACHED_CHARS, CACHED_SEGMENTS, CACHED_PAIRS = 48, 400_000, 1_000_000
#: The recurrence to a boundary needs the characters before it only: it is kept for beginnings of these lengths, longest first, so many a worker.
BEGINNINGS, CACHED_BEGINNINGS = (8, 5), 100_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], list[int], list[bytes]]:
    """(piece, score) by id ("" for ids that are not text), ids of the 256 bytes, and the bytes that each id decodes to."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text, byte_ids, decoded = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        else:
            decoded.append(b"" if special else piece.replace(MARK, " ").encode("utf-8"))
        text.append(("" if special or model.is_byte(i) else piece, model.get_score(i)))
    return text, byte_ids, decoded


class StreamingEncoder:
    """Encodes one segment, given in parts, with a window of uncommitted boundaries.

    A boundary that no coming piece can start from and that no later path goes through is dead. When the committed
    boundary has one living successor left, all surviving paths lead through that one, and it is committed in turn.
    """

    def __init__(self, tables: "Tables"):
        self.tables = tables
        self.text = ""  # from the committed boundary on; earlier characters go at the end of a part
        self.root = 0  # the committed boundary
        self.before = -1  # the piece before it
        self.last: list[int] = [-1]  # last piece of the best path to each boundary
        self.back: list[int] = [0]
        self.paths: list[int] = [0]  # living boundaries whose back pointer is this one
        self.dead: list[bool] = [False]
        self.committed = array("i")

    def feed(self, part: str) -> None:
        t = self.tables
        self.text += part
        text, last, back, paths = self.text, self.last, self.back, self.paths
        for j in range(len(last), len(text) + 1):
            for i in range(max(self.root, j - t.longest), j):
                piece = t.ids.get(text[i:j])
                if piece is None:
                    continue
                left = last[i] if i > self.root else self.before
                if left < 0 or t.stable(left, piece):
                    last.append(piece)
                    back.append(i)
                    paths[i] += 1
                    break
            else:
                # No piece ends here: a character outside the alphabet, spelt in bytes. What stands on either side is apart.
                self._commit_path(j - 1)
                self.committed.extend(t.spell(text[j - 1]))
                last.append(-1)
                back.append(j - 1)
                self.root, self.before = j, -1
            paths.append(0)
            self.dead.append(False)
            if j - t.longest >= self.root:
                self._leave(j - t.longest)
        self._trim()

    def _leave(self, boundary: int) -> None:
        """No coming piece starts at the boundary or before it."""
        last, back, paths = self.last, self.back, self.paths
        k = boundary
        while k > self.root and not paths[k]:
            self.dead[k] = True
            k = back[k]
            paths[k] -= 1
        while self.root <= boundary and paths[self.root] == 1:
            follows = range(self.root + 1, min(self.root + self.tables.longest, len(last) - 1) + 1)
            self.root = next(c for c in follows if back[c] == self.root and not self.dead[c])
            self.before = last[self.root]
            self.committed.append(self.before)

    def _commit_path(self, boundary: int) -> None:
        path = []
        while boundary > self.root:
            path.append(self.last[boundary])
            boundary = self.back[boundary]
        self.committed.extend(path[::-1])

    def _trim(self) -> None:
        """Forget what lies before the committed boundary."""
        gone = self.root
        if gone:
            self.text, self.last, self.paths, self.dead, self.root = self.text[gone:], self.last[gone:], self.paths[gone:], self.dead[gone:], 0
            self.back = [max(0, b - gone) for b in self.back[gone:]]

    def finish(self) -> array:
        self._commit_path(len(self.text))
        return self.committed


class Tables:
    """The model's pieces with the caches of one worker."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], decoded: list[bytes]):
        self.byte_ids, self.decoded = byte_ids, decoded
        self.score = {p: s for p, s in pieces if p}
        self.piece = [p for p, _ in pieces]
        self.pairs: dict[int, bool] = {}
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        self.segments: dict[str, bytes] = {}
        self.beginnings: dict[str, tuple[tuple, tuple]] = {}
        alphabet = set("".join(self.score))
        #: Neighbours within some piece; no merge joins any other two characters.
        self.neighbours = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        # Pieces that merging never makes cannot be part of a path.
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p and self.merge(p) == [p]}
        self.longest = max(map(len, self.ids), default=1)
        #: Length of the longest piece with a given ending; other endings have pieces of up to two characters only.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        cut = "" if "\n" in alphabet else "\n"
        self.segment = re.compile(f"{cut}|{MARK}*[^{MARK}{cut}]+|{MARK}+" if cut else f"{MARK}*[^{MARK}]+|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """Merge adjacent parts, best score and then leftmost first, until no joint part is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces again: no merge crosses their border."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _merges(self, piece: int) -> list[tuple[float, str, str]]:
        """From the piece's characters on: the score of the merge that comes next (least at the end), the first and the last part before it."""
        known = self.merges.get(piece)
        if known is None:
            parts, known = list(self.piece[piece]), []
            while len(parts) > 1:
                best, at = max((self.score.get(x + y, _NO_MERGE), -k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                known.append((best, parts[0], parts[-1]))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            known.append((_NO_MERGE, parts[0], parts[-1]))
            self.merges[piece] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """The merges of both in their order, best score and then leftmost first, until the parts at the border merge or nothing does."""
        score, a, b = self.score.get, iter(self._merges(left)), iter(self._merges(right))
        (on_left, _, x), (on_right, y, _) = next(a), next(b)
        while True:
            joint = score(x + y)
            if joint is not None and joint > on_left and joint >= on_right:
                return False
            if on_left >= on_right:
                if on_left == _NO_MERGE:
                    return True
                on_left, _, x = next(a)
            else:
                on_right, y, _ = next(b)

    def forget(self) -> None:
        """Drop the caches, so that what a worker holds between tasks is the model alone."""
        self.pairs.clear()
        self.segments.clear()
        self.beginnings.clear()

    def spell(self, char: str) -> list[int]:
        raw = MARK.encode("utf-8") if char == _OWN_MARK else char.encode("utf-8")
        return [self.byte_ids[b] for b in raw]

    def _within_window(self, segment: str) -> bytes | None:
        """The same recurrence for a segment no longer than the window, whose paths all meet at its end; None if a character needs spelling."""
        ids, pairs, reach = self.ids.get, self.pairs.get, self.reach.get
        last, back, size = [-1], [0], len(segment)
        for n in BEGINNINGS:
            if n < size:
                known = self.beginnings.get(segment[:n])
                if known is not None:
                    last, back = list(known[0]), list(known[1])
                    break
        for j in range(len(last), size + 1):
            for i in range(max(0, j - reach(segment[j - 3 : j], 2)) if j > 2 else 0, j):
                piece = ids(segment[i:j])
                if piece is not None:
                    if i:
                        fits = pairs(last[i] << 32 | piece)
                        if fits is None:
                            fits = self.stable(last[i], piece)
                        if not fits:
                            continue
                    last.append(piece)
                    back.append(i)
                    break
            else:
                return None
            if j in BEGINNINGS and j < size:
                if len(self.beginnings) >= CACHED_BEGINNINGS:
                    self.beginnings.clear()
                self.beginnings[segment[:j]] = tuple(last), tuple(back)
        out, j = [], size
        while j:
            out.append(last[j])
            j = back[j]
        return array("i", out[::-1]).tobytes()

    def _parts(self, segment: str) -> list[str]:
        """The segment cut between characters that are neighbours in no piece."""
        near = self.neighbours
        cuts = [0, *(k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in near), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_segment(self, segment: str) -> bytes:
        """Ids, 4 bytes each, of a segment between two boundaries that no piece crosses."""
        if len(segment) > CACHED_CHARS:
            return self._encode_part(segment)
        # Letters alone are seldom cut, so they are not looked at.
        parts, known = [segment] if segment[1:].isalpha() else self._parts(segment), self.segments
        if len(parts) == 1:
            return self._kept(segment, self._encode_part(segment))
        return self._kept(segment, b"".join([known.get(p) or self._kept(p, self._encode_part(p)) for p in parts]))

    def _kept(self, segment: str, ids: bytes) -> bytes:
        if len(self.segments) >= CACHED_SEGMENTS:
            self.segments.clear()
        self.segments[segment] = ids
        return ids

    def _encode_part(self, segment: str) -> bytes:
        ids = self._within_window(segment) if len(segment) <= self.longest else None
        if ids is None:
            encoder = StreamingEncoder(self)
            for start in range(0, len(segment), 4096):
                encoder.feed(segment[start : start + 4096])
            ids = encoder.finish().tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)
        known = self.segments
        return b"".join([known.get(s) or self.encode_segment(s) for s in self.segment.findall(marked)])

    def decode(self, ids: bytes) -> str:
        decoded = self.decoded
        raw = b"".join([decoded[i] for i in array("i", ids)])
        return raw[1:].decode("utf-8")


_TABLES: dict[str, Tables] = {}


def _tables(model) -> Tables:
    """The tables of a broadcast model, made once a worker."""
    key, parts = model.value
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(*parts)
    return _TABLES[key]


def _broadcast(spark: SparkSession, path: str | None):
    """The model's pieces under a name of their own, by which workers know whether they have them."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, load_pieces(path or default_model())))


#: Ids of one Arrow batch of output, about.
_FLUSH = 1 << 20


def encode_texts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_ids."""
    model = _broadcast(docs.sparkSession, model_path)

    def rows(doc_ids, encoded):
        counts = [0 if e is None else len(e) // 4 for e in encoded]
        offsets = np.zeros(len(encoded) + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        values = np.frombuffer(b"".join(e for e in encoded if e), np.int32)
        mask = pa.array([e is None for e in encoded])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)
        n = pa.array([None if e is None else c for e, c in zip(encoded, counts)], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids, n], names=["doc_id", "ids", "n_ids"])

    def run(batches):
        t = _tables(model)
        doc_ids, encoded, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                doc_ids.append(doc_id)
                encoded.append(None if text is None else t.encode(text))
                held += len(encoded[-1] or b"") // 4
                if held > _FLUSH:
                    yield rows(doc_ids, encoded)
                    doc_ids, encoded, held = [], [], 0
        if doc_ids:
            yield rows(doc_ids, encoded)
        t.forget()

    src = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return src.mapInArrow(run, "doc_id long, ids array<int>, n_ids long")


def decode_ids(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    model = _broadcast(rows.sparkSession, model_path)

    def run(batches):
        t = _tables(model)
        for batch in batches:
            texts = [None if ids is None else t.decode(array("i", ids).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of 32-bit little-endian ids), text_sha256 (of the text decoded from the ids), exact (it is the text)."""
    model = _broadcast(docs.sparkSession, model_path)

    def run(batches):
        t = _tables(model)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = t.encode(text or "")
                back = t.decode(ids)
                out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), back == (text or "")))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                names = ["doc_id", "n_ids", "ids_sha256", "text_sha256", "exact"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)
        t.forget()

    src = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return src.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, text_sha256 string, exact boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
