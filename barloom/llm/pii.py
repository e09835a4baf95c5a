"""Op 10: information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers (the
base kinds) and secrets: unbroken tokens of mixed letters and digits that carry at
least SECRET_BITS of information. Terms of the corpus that reveal an entity, or
that one of a kind is at hand, are found from co-occurrence counts over all
documents. For a term within REACH words of a subject (one entity, or any entity
of one kind) the disclosure is log2(P(subject | term) / P(subject)) bits, where
P(subject | term) is the share of the term's occurrences near the subject, smoothed
by SMOOTHING occurrences that follow P(subject), the share of all words near it.

A term is risky if P(subject | term) is at least CONFIDENCE, the disclosure is at
least BITS (of one entity) or KIND_BITS (of a kind), and the evidence is
independent: one entity in SUPPORT different contexts at least (copies of a
passage are one), a kind by SUPPORT different entities. Occurrences of risky terms
are spans of kind `term`. In a sanitised text entities are generalised to their
kind, terms that reveal a kind to [KIND-TERM], and terms that reveal one entity are
removed.

Terms are compared as 64-bit hashes; entities are counted under digests, so no
table between the steps holds a protected value.

Defined results: a null or empty text has no spans; overlapping base spans of
different kinds all stay and are merged in a sanitised text; a secret that touches
a base span is none; a term that reveals both a kind and an entity is removed;
repeated rows get equal results and count once each; an empty table gives no rows;
input columns other than `text` are kept by `sanitise` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import cut_lineage, join_by_weight, read_table

KINDS = ("email", "ip", "card", "phone")
#: All kinds of protected entities: the base ones, and those that the method adds.
PROTECTED = (*KINDS, "secret")
REACH = 6
SUPPORT, CONFIDENCE, SMOOTHING = 3, 0.75, 1.0
BITS, KIND_BITS = 8.0, 6.0
#: A secret's least length, changes between letters and digits, and bits (its length times the entropy of its characters).
SECRET_CHARS, SECRET_CHANGES, SECRET_BITS = 20, 4, 64.0
#: Risky terms that one pass over the texts holds (9 bytes each); more terms take more passes, each written before the next.
TERMS_PER_PASS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    """Each @ with a run of local characters before it, back to the last match, and a domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then start."""
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, find in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            out.extend((kind, *s) for s in find(text))
    return out


_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SECRET_CHARS)
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def _is_secret(token: str) -> bool:
    if sum(1 for _ in _CHANGE.finditer(token)) < SECRET_CHANGES:
        return False
    counts = np.unique(np.frombuffer(token.encode("ascii"), np.uint8), return_counts=True)[1]
    return float((counts * np.log2(len(token) / counts)).sum()) >= SECRET_BITS


def secret_spans(text: str | None, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(secret, start, end) of tokens that no base span touches, in code points."""
    if not text or not _DIGIT.search(text):
        return []
    found = [m.span() for m in _TOKEN.finditer(text) if _is_secret(m[0])]
    if not found:
        return []
    taken = base_spans(text) if base is None else base
    return [("secret", a, b) for a, b in found if all(b <= x or y <= a for _, x, y in taken)]


def entity_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All protected entities: base spans, then secrets."""
    base = base_spans(text)
    return base + secret_spans(text, base)


def _digest64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, text: str) -> int:
    """A digest of the protected value: two spellings of one number are one entity."""
    value = text.lower() if kind == "email" else text if kind in ("ip", "secret") else _NOT_DIGIT.sub("", text)
    return _digest64(f"{kind}:{value}".encode())


def _byte_offsets(text: str, points: list[int]) -> list[int]:
    if text.isascii():
        return points
    out, last, held = [], 0, 0
    order = sorted(range(len(points)), key=points.__getitem__)
    at = [0] * len(points)
    for k in order:
        held += len(text[last : points[k]].encode("utf-8"))
        last = points[k]
        at[k] = held
    out.extend(at)
    return out


def _batch_words(texts: pa.Array):
    data, offsets = shingles.text_bytes(texts)
    starts, stops, first = shingles.words(data, offsets)
    return offsets, starts, stops, first, shingles.word_hashes(data, starts, stops).view(np.int64)


def _outside(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Words that no base span touches: parts of an entity are not terms about it."""
    free = np.ones(len(starts), bool)
    for a, b in spans:
        free[np.searchsorted(stops, a, side="right") : np.searchsorted(starts, b, side="left")] = False
    return free


_COUNTS = pa.schema([("term", pa.int64()), ("subject", pa.string()), ("context", pa.int64()), ("n", pa.int64())])


def _count_rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _count(batches):
    """Occurrences of terms (subject null), of terms near subjects by context, and of words near subjects (term null).

    A subject is an entity (kind:digest), whose contexts are the words around it, or a kind, whose contexts are entities.
    """
    for batch in shingles.small_batches(batches):
        texts = batch.column("text")
        offsets, starts, stops, first, hashes = _batch_words(texts)
        near: dict[tuple[int, str, int], int] = {}
        about: dict[str, int] = {}
        for i, text in enumerate(texts.to_pylist()):
            spans = entity_spans(text)
            if not spans:
                continue
            lo, hi = first[i], first[i + 1]
            s, e, own = starts[lo:hi] - offsets[i], stops[lo:hi] - offsets[i], hashes[lo:hi]
            flat = _byte_offsets(text, [p for _, a, b in spans for p in (a, b)])
            cut = list(zip(flat[::2], flat[1::2]))
            free = _outside(s, e, cut)
            told = {kind: np.zeros(hi - lo, bool) for kind in PROTECTED}
            for (kind, a, b), (ba, bb) in zip(spans, cut):
                entity = _entity(kind, text[a:b])
                left, right = np.searchsorted(e, ba, side="right"), np.searchsorted(s, bb, side="left")
                around = np.r_[max(0, left - REACH) : left, right : min(hi - lo, right + REACH)]
                around = around[free[around]]
                # A word near two entities of a kind is near that kind once.
                fresh = around[~told[kind][around]]
                told[kind][fresh] = True
                for subject, context, words in ((f"{kind}:{entity}", _digest64(own[around].tobytes()), own[around]), (kind, entity, own[fresh])):
                    about[subject] = about.get(subject, 0) + len(words)
                    for h, n in zip(*(x.tolist() for x in np.unique(words, return_counts=True))):
                        near[h, subject, context] = near.get((h, subject, context), 0) + n
        values, counts = np.unique(hashes, return_counts=True)
        yield _count_rows(values, [None] * len(values), [None] * len(values), counts)
        if about:
            yield _count_rows([None] * len(about), list(about), [None] * len(about), list(about.values()))
        if near:
            yield _count_rows(*zip(*near), list(near.values()))


def risky_terms(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, bits: float = BITS, kind_bits: float = KIND_BITS) -> DataFrame:
    """term (hash), subject, near, contexts, about, occurrences, share, bits: terms that reveal a protected entity or its kind."""
    rows = docs.select("text").mapInArrow(_count, "term long, subject string, context long, n long")
    counts = cut_lineage(rows.groupBy("term", "subject", "context").agg(F.sum("n").alias("n")))
    near = counts.where("context IS NOT NULL").groupBy("term", "subject").agg(F.sum("n").alias("near"), F.count("*").alias("contexts"))
    near = cut_lineage(near.where(F.col("contexts") >= support))
    about = counts.where("term IS NULL").select("subject", F.col("n").alias("about"))
    # A kind is the subject of most terms, an entity may be that of very many: neither is one task's.
    about = cut_lineage(about.join(near.groupBy("subject").agg(F.count("*").alias("_terms")), "subject"))
    total = counts.where("subject IS NULL").select("term", F.col("n").alias("occurrences"))
    words = float(counts.where("subject IS NULL").agg(F.sum("n")).first()[0] or 1)
    joined = join_by_weight(near, about, ["subject"], "_terms", near.count()).drop("_terms").join(total, "term")
    usual = F.col("about") / F.lit(words)
    joined = joined.withColumn("share", (F.least("near", "occurrences") + SMOOTHING * usual) / (F.col("occurrences") + SMOOTHING))
    judged = joined.withColumn("bits", F.log2(F.col("share") / usual))
    least = F.when(F.col("subject").contains(":"), F.lit(float(bits))).otherwise(F.lit(float(kind_bits)))
    return judged.where((F.col("share") >= confidence) & (F.col("bits") >= least))


def term_codes(terms: DataFrame) -> DataFrame:
    """term, code: 0, removal, where the term reveals one entity; else the kind about which it tells most, PROTECTED[code - 1]."""
    place = F.array_position(F.array(*map(F.lit, PROTECTED)), F.col("subject")).cast("int")
    ranked = F.struct(F.when(place == 0, 0).otherwise(1), -F.col("bits"), place.alias("code"))
    return terms.groupBy("term").agg(F.min(ranked).getField("code").alias("code"))


def _term_spans(block, finish=None):
    """Adds occurrences of a sorted block of terms to `terms`, an array of (start, end, code); `finish` makes the rows to return of such batches."""

    def run(batches):
        known, codes = block.value
        for batch in shingles.small_batches(batches):
            texts = batch.column("text")
            offsets, starts, stops, first, hashes = _batch_words(texts)
            at = np.zeros(len(hashes), np.int64)
            hit = np.zeros(len(hashes), bool)
            if len(known) and len(hashes):
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes
            by_text = np.concatenate([[0], np.cumsum(hit)])[first]
            where = np.flatnonzero(hit)
            found = []
            earlier = batch.column("terms").to_pylist()
            for i in range(batch.num_rows):
                mine = where[by_text[i] : by_text[i + 1]]
                if not len(mine):
                    found.append(earlier[i])
                    continue
                text = texts[i].as_py()
                flat = _byte_offsets(text, [p for _, a, b in entity_spans(text) for p in (a, b)])
                mine = mine[_outside(starts[mine] - offsets[i], stops[mine] - offsets[i], list(zip(flat[::2], flat[1::2])))]
                points = _code_points(text, (starts[mine] - offsets[i]).tolist(), (stops[mine] - offsets[i]).tolist())
                new = [{"start": a, "end": b, "code": int(c)} for (a, b), c in zip(points, codes[at[mine]])]
                found.append(sorted([*(earlier[i] or []), *new], key=lambda s: s["start"]))
            cols = [batch.column(n) if n != "terms" else pa.array(found, batch.schema.field("terms").type) for n in batch.schema.names]
            marked = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield from finish([marked]) if finish else (marked,)

    return run


def _code_points(text: str, starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Byte positions of ordered, disjoint words as positions in code points."""
    if text.isascii():
        return list(zip(starts, stops))
    raw, out, byte, point = text.encode("utf-8"), [], 0, 0
    for a, b in zip(starts, stops):
        point += len(raw[byte:a].decode("utf-8"))
        end = point + len(raw[a:b].decode("utf-8"))
        out.append((point, end))
        byte, point = b, end
    return out


def mark_terms(docs: DataFrame, terms: DataFrame, finish=None, schema=None) -> DataFrame:
    """Adds `terms`: spans of words whose hash is in the table of terms and codes; or what `finish` makes of such rows, in the last pass.

    A pass holds TERMS_PER_PASS terms on the driver and on each worker; where there are more, a pass's
    rows are written to the shared folder before the next begins.
    """
    kept = cut_lineage(terms.select("term", "code"))
    blocks = max(1, -(-kept.count() // TERMS_PER_PASS))
    out = docs.withColumn("terms", F.array().cast("array<struct<start:int,end:int,code:int>>"))
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).toArrow().sort_by("term")
        block = docs.sparkSession.sparkContext.broadcast((rows["term"].to_numpy(), rows["code"].to_numpy().astype(np.int8)))
        if k < blocks - 1:
            out = cut_lineage(out.mapInArrow(_term_spans(block), out.schema))
            block.destroy()
    return out.mapInArrow(_term_spans(block, finish), schema or out.schema)


def _spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_term long, n_spans long"


def _digest(batches):
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    types = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names]
    for batch in shingles.small_batches(batches):
        rows = []
        for doc_id, text, terms in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "terms"))):
            base = base_spans(text)
            secrets = secret_spans(text, base)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            every = [*base, *secrets, *(("term", t["start"], t["end"]) for t in terms)]
            rows.append((doc_id, *counts, hashlib.sha256(_spans_text(base).encode()).hexdigest(), _spans_text(every), len(secrets), len(terms), len(every)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def sanitise_text(text: str, terms: list[dict]) -> str:
    """Entities become [KIND]; of overlapping ones the first, then the longest, names the joint span; terms are removed or become [KIND-TERM]."""
    marks = [(a, -b, f"[{k.upper()}]") for k, a, b in entity_spans(text)]
    marks += [(t["start"], -t["end"], f"[{PROTECTED[t['code'] - 1].upper()}-TERM]" if t["code"] else "") for t in terms]
    marks.sort()
    out, at, n = [], 0, 0
    while n < len(marks):
        start, end, name = marks[n][0], -marks[n][1], marks[n][2]
        n += 1
        while n < len(marks) and marks[n][0] < end:
            end = max(end, -marks[n][1])
            n += 1
        out.extend((text[at:start], name))
        at = end
    out.append(text[at:])
    return "".join(out)


def _sanitise(batches):
    """The rows in `_row`, with their texts sanitised."""
    for batch in batches:
        row = batch.column("_row")
        texts = [t and sanitise_text(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist())]
        columns = {f.name: c for f, c in zip(row.type, row.flatten())}
        columns["text"] = pa.array(texts, columns["text"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sanitise(docs: DataFrame) -> DataFrame:
    """The input with sanitised texts; all other columns as they were."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return mark_terms(packed, term_codes(risky_terms(docs)), _sanitise, docs.schema)


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of base entities, all spans (base, secret, term), and the counts of what the method adds."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark_terms(src, term_codes(risky_terms(src)), _digest, _DIGESTS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
