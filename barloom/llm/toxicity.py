"""Op 3: toxicity by weak supervision.

Many voters look at a text: words and beginnings of words mined from the labelled
rows so that together they reach as many toxic families as they can, each stem of a small lexicon of four languages, and patterns. A generative label model explains the votes of all
documents by a hidden label: it has, for each class, a tree of voters (the
strongest correlations given the class) and each voter's rate given its
parent's vote, so accuracies and correlations are estimated together, by
expectation maximisation from the rates on the labelled rows, which keep their labels; a voter that does not fire abstains. A linear classifier on votes and
the presence of words and their beginnings is then trained on the posterior labels of a bounded sample
of labelled rows, and scores every text.

No label of a held-out row is read; language, source and id are never inputs.
Defined results: null and empty texts have no votes and no words and get the
classifier's score of that; without labelled rows of both kinds the lexicon and
patterns vote alone; repeated rows get equal scores; an empty table gives no
rows; other input columns are ignored by `score_toxicity` and kept by `keep_clean`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import cut_lineage, held_out, read_table
from barloom.llm.labelled import bounded_sample, labelled_texts, training_labels

#: Labelled rows that the linear classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: Mined voters, at most; each is in so many toxic families, in so large a share of them, so large a share of its families is toxic, and it adds so many that no other mined one reaches.
MINED, MIN_FAMILIES, MIN_REACH, MIN_SHARE, MIN_ADDED = 40, 5, 0.015, 0.9, 2
#: Features that mining chooses from, at most: those that tell most about the label.
CANDIDATES = 8192
#: Bytes of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 6, 8)
#: Features of the classifier, at most: those whose presence tells most about the label; and its ridge.
VOCABULARY, RIDGE = 1024, 2e-3
ROUNDS = 8
THRESHOLD = 0.5

#: A short lexicon: one voter a stem, with its forms in the languages of the corpus; a form is a whole word or, with a star, its beginning.
LEXICON = (
    ("idiot*",), ("moron*",), ("stupid*", "estúpid*", "stupide*"), ("dumb", "dumbass", "dumm*"), ("imbecil*", "imbécil*", "imbezil*"),
    ("loser*", "versager*", "perdant*", "perdedor*"), ("scum*", "abschaum*", "racaille*", "escoria*"), ("trash", "trashy", "basura*", "ordure*"),
    ("pathetic*", "patétic*", "pathétique*", "erbärmlich*"), ("worthless*", "wertlos*", "minable*", "inútil*"), ("disgusting*", "widerlich*", "dégueulasse*", "asqueros*"),
    ("clown", "clowns"), ("trottel*", "crétin*", "cretin*"), ("arschloch*", "connard*", "salaud*", "gilipollas*"),
)
_INSULT = r"(?:you|they|he|she) (?:are|is|were) (?:an? |such an? )?(?:idiot|moron|loser|clown|fool)s?"
_ORDER = r"(?:shut up|get lost|go to hell|drop dead|hate you)"


def _anywhere(pattern: str) -> str:
    """For RE2: the pattern at any place in a word, in any case; re.I also takes dotless and dotted capital i for i."""
    return "(?i)" + pattern.replace("i", "[iıİ]")


#: Patterns, each with an expression that Arrow finds in every text with a match; other texts need no search.
_PATTERNS = (
    (re.compile(rf"\b{_INSULT}\b", re.I), _anywhere(_INSULT)),
    (re.compile(rf"\b{_ORDER}\b", re.I), _anywhere(_ORDER)),
    (re.compile(r"\b[a-z]\*{2,}[a-z]+\b", re.I), r"\*\*"),
)


def _head_hashes(words: list[bytes]) -> list[int]:
    """Hashes of the first bytes of words, as those of the shortest beginnings."""
    heads = [w[: BEGINNINGS[0]] for w in words]
    ends = np.cumsum([len(h) for h in heads])
    return shingles.word_hashes(np.frombuffer(b"".join(heads), np.uint8), np.append(0, ends[:-1]), ends).tolist()


def _features(batch):
    """For every word of a batch and each of its features: text, feature hash, kind (the longer the later) and its first beginning's hash; and all bytes, starts and ends of words."""
    data, offsets = shingles.text_bytes(batch.column("text"))
    starts, stops, first = shingles.words(data, offsets, shingles.word_bytes(data))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
    hash_of = shingles.WordHashes(data)
    stem = hash_of(starts, np.minimum(stops, starts + BEGINNINGS[0]))
    parts = [(rows, stem, stem)]
    for length in BEGINNINGS[1:]:
        longer = stops - starts >= length
        parts.append((rows[longer], hash_of(starts[longer], starts[longer] + length), stem[longer]))
    parts.append((rows, hash_of(starts, stops), stem))
    kinds = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p[0]) for p in parts])
    rows, hashes, stems = (np.concatenate(c) for c in zip(*parts))
    with np.errstate(over="ignore"):
        return rows, shingles.mix(hashes + kinds * np.uint64(0x9E3779B97F4A7C15)), kinds, stems, (data, starts, stops)


def _lookup(rows: np.ndarray, hashes: np.ndarray, vocabulary: np.ndarray):
    """Unique (text, position in the sorted vocabulary) pairs."""
    if not len(vocabulary) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == hashes
    pairs = np.unique(rows[hit] * len(vocabulary) + at[hit])
    return pairs // len(vocabulary), pairs % len(vocabulary)


class Voters:
    """The mined features (sorted hashes), the stems of the lexicon and the patterns; a vote is whether the voter fires."""

    def __init__(self, mined: np.ndarray, lexicon=LEXICON):
        self.mined = np.sort(mined)
        self.stems = [[f[:-1].encode("utf-8") for f in forms if f.endswith("*")] for forms in lexicon]
        self.forms = [{f.encode("utf-8") for f in forms if not f.endswith("*")} for forms in lexicon]
        #: The stems to look at for a word with this beginning.
        self.heads: dict[int, set[int]] = {}
        for k, forms in enumerate(lexicon):
            for h in _head_hashes([f.rstrip("*").encode("utf-8") for f in forms]):
                self.heads.setdefault(h, set()).add(k)
        self.head_hashes = np.sort(np.array(list(self.heads), np.uint64))
        self.size = len(self.mined) + len(lexicon) + len(_PATTERNS)
        if self.size > 62:
            raise ValueError("votes are packed into the bits of a long")

    def _lexicon_votes(self, features, out: np.ndarray) -> None:
        rows, _, _, stems, (data, starts, stops) = features
        heads = stems[: len(starts)]
        if not len(heads) or not len(self.head_hashes):
            return
        at = np.searchsorted(self.head_hashes, heads)
        at[at == len(self.head_hashes)] = 0
        for w in np.flatnonzero(self.head_hashes[at] == heads).tolist():
            word = shingles.LOWER[data[starts[w] : stops[w]]].tobytes()
            for k in self.heads[int(heads[w])]:
                if word in self.forms[k] or any(word.startswith(s) for s in self.stems[k]):
                    out[rows[w], len(self.mined) + k] = True

    def votes(self, batch, features=None) -> np.ndarray:
        features = features or _features(batch)
        out = np.zeros((batch.num_rows, self.size), bool)
        out[_lookup(*features[:2], self.mined)] = True
        self._lexicon_votes(features, out)
        texts, offset = batch.column("text"), self.size - len(_PATTERNS)
        for k, (pattern, anywhere) in enumerate(_PATTERNS):
            likely = np.flatnonzero(pc.match_substring_regex(texts, anywhere).fill_null(False).to_numpy(zero_copy_only=False))
            for i in likely.tolist():
                if pattern.search(texts[i].as_py()):
                    out[i, offset + k] = True
        return out


def common_features(rows: DataFrame) -> list:
    """(feature, kind, stem, toxic, texts) of the features in enough toxic families, those that tell most about the label first.

    Each is in MIN_REACH of these families at least, so there are no more than the
    features of an average text divided by that share.
    """

    def count(batches):
        for batch in shingles.small_batches(batches):
            which, hashes, kinds, stems = _features(batch)[:4]
            if not len(hashes):
                continue
            order = np.lexsort((which, hashes))
            h, w = hashes[order], which[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
            h, order = h[fresh], order[fresh]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            columns = (h[start].view(np.int64), kinds[order][start].astype(np.int32), stems[order][start].view(np.int64), np.diff(np.append(start, len(h))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "kind", "stem", "toxic"])

    sizes = dict(rows.groupBy("target").count().collect())
    enough = max(MIN_FAMILIES, MIN_REACH * sizes.get(1, 0))
    counts = rows.where("target = 1").mapInArrow(count, "feature long, kind int, stem long, toxic long").groupBy("feature", "kind", "stem").agg(F.sum("toxic").alias("toxic"))
    found = counts.where(F.col("toxic") >= enough).collect()
    texts = _texts_with(rows, np.sort(np.array([r["feature"] for r in found], np.int64).view(np.uint64)))
    every = np.array([texts[r["feature"]] for r in found], float)
    gain = _information(np.array([r["toxic"] for r in found], float), every, sizes.get(1, 0), sum(sizes.values()))
    order = sorted(range(len(found)), key=lambda k: (-gain[k], found[k]["kind"], found[k]["feature"]))
    return [(*found[k], texts[found[k]["feature"]]) for k in order]


def _texts_with(rows: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How many of all labelled rows have each feature."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in shingles.small_batches(batches):
            total += np.bincount(_lookup(*_features(batch)[:2], vocabulary)[1], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])], names=["feature", "texts"])

    counted = rows.mapInArrow(count, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).collect()
    return {r["feature"]: r["texts"] for r in counted}


def _information(toxic: np.ndarray, texts: np.ndarray, all_toxic: int, rows: int) -> np.ndarray:
    """Mutual information of label and presence, by counts of toxic and of all rows with a feature."""
    out = np.zeros(len(toxic))
    for both, with_feature, with_label in ((toxic, texts, all_toxic), (texts - toxic, texts, rows - all_toxic), (all_toxic - toxic, rows - texts, all_toxic), (rows - all_toxic - texts + toxic, rows - texts, rows - all_toxic)):
        some = both > 0
        out[some] += both[some] / rows * np.log(both[some] * rows / (with_feature[some] * with_label))
    return out


def _held_features(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the sorted vocabulary) pairs of all rows, which must be a bounded sample; rows are numbered here."""

    def run(batches):
        for batch in shingles.small_batches(batches):
            row, col = _lookup(*_features(batch)[:2], vocabulary)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [col[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["columns"])

    found = [np.frombuffer(b, np.uint16).astype(np.int64) for b in rows.mapInArrow(run, "columns binary").toArrow()["columns"].to_pylist()]
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found])


def mine_words(common: list, toxic_rows: DataFrame) -> np.ndarray:
    """Hashes of features that speak for label 1 and together reach as many toxic families as they can.

    Of the features of which at least MIN_SHARE of the families are toxic, the one in most families that no
    chosen one is in comes next, as long as it adds MIN_ADDED of them; ties go to the shorter and then to the clearer.
    toxic_rows are a bounded sample of rows of label 1, one a family.
    """
    clear = [(feature, kind, toxic / texts) for feature, kind, _, toxic, texts in common if toxic >= MIN_SHARE * texts][:CANDIDATES]
    if not clear:
        return np.zeros(0, np.uint64)
    hashes, kinds, shares = (np.array(c) for c in zip(*clear))
    order = np.argsort(hashes.astype(np.int64).view(np.uint64))
    vocabulary, kinds, shares = hashes.astype(np.int64).view(np.uint64)[order], kinds[order], shares[order]
    rows, cols = _held_features(toxic_rows, vocabulary)
    chosen: list[int] = []
    while len(chosen) < MINED:
        added = np.bincount(cols, minlength=len(vocabulary))
        best = max(range(len(vocabulary)), key=lambda k: (added[k], -kinds[k], shares[k], -k))
        if added[best] < MIN_ADDED:
            break
        chosen.append(best)
        left = ~np.isin(rows, rows[cols == best])
        rows, cols = rows[left], cols[left]
    return vocabulary[chosen]


class LabelModel:
    """P(label) and, given each label, a tree of voters with P(vote | parent's vote)."""

    def __init__(self, prior: float, singles: np.ndarray, pairs: np.ndarray, weight: np.ndarray):
        """singles[y, i] and pairs[y, i, j]: weights of documents in which i fires, or both do; weight[y]: of all."""
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        m = singles.shape[1]
        smooth = 0.5
        total = weight[:, None, None] + 4 * smooth
        one = (singles + 2 * smooth) / (weight[:, None] + 4 * smooth)
        both = (pairs + smooth) / total
        i_only, j_only = one[:, :, None] - both, one[:, None, :] - both
        none = 1 - both - i_only - j_only
        cells = np.clip(np.stack([none, j_only, i_only, both]), 1e-9, 1)
        apart = np.stack([np.einsum("yi,yj->yij", a, b) for a in (1 - one, one) for b in (1 - one, one)])
        information = (cells * np.log(cells / np.clip(apart, 1e-12, 1))).sum(axis=0).sum(axis=0)
        #: The correlations kept: a maximum spanning tree over the information that votes share given the label.
        self.parent = np.full(m, -1)
        best, source, inside = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, bool)
        for _ in range(m):
            k = int(np.argmax(np.where(inside, -np.inf, best))) if inside.any() else 0
            inside[k] = True
            self.parent[k] = source[k]
            closer = ~inside & (information[k] > best)
            best[closer], source[closer] = information[k][closer], k
        #: rate[y, v, i]: P(i fires | label y, its parent's vote is v).
        self.rate = np.zeros((2, 2, m))
        for k in range(m):
            p = self.parent[k]
            for y in (0, 1):
                fired = both[y, k, p] if p >= 0 else one[y, k]
                self.rate[y, 1, k] = fired / one[y, p] if p >= 0 else fired
                self.rate[y, 0, k] = (one[y, k] - fired) / (1 - one[y, p]) if p >= 0 else fired
        self.rate = np.clip(self.rate, 1e-4, 1 - 1e-4)
        #: accuracy[y, i]: the estimated share of texts with label y in which voter i fires.
        self.accuracy = one

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1). A voter that does not fire abstains: it tells nothing, as most voters know one language or one insult only."""
        parents = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0).astype(int)
        logs = []
        for y, p in ((0, 1 - self.prior), (1, self.prior)):
            rate = np.take_along_axis(self.rate[y], parents, axis=0)
            logs.append(np.log(p) + np.where(votes, np.log(rate), 0).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _pattern_counts(docs: DataFrame, voters: Voters) -> DataFrame:
    """pattern (bits of the votes), n: over all documents."""

    def run(batches):
        for batch in shingles.small_batches(batches):
            bits = voters.votes(batch) @ (1 << np.arange(voters.size, dtype=np.int64))
            values, n = np.unique(bits, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _moments(patterns: DataFrame, size: int, model: LabelModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected weights of voters, of pairs of voters and of all documents, by label: size**2 numbers a task."""

    def run(batches):
        total = np.zeros((2, size + 1, size + 1))
        for batch in batches:
            bits, n = batch.column("pattern").to_numpy(), batch.column("n").to_numpy()
            votes = (bits[:, None] >> np.arange(size) & 1).astype(float)
            p = model.posterior(votes > 0)
            full = np.hstack([votes, np.ones((len(bits), 1))])
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                total[y] += full.T @ (full * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = patterns.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (size + 1) ** 2)
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(2, size + 1, size + 1)
    return total[:, size, :size], total[:, :size, :size], total[:, size, size]


def fit_label_model(docs: DataFrame, rows: DataFrame, voters: Voters) -> LabelModel:
    """Starts from the rates on the labelled rows, then explains the votes of all documents.

    The labelled rows keep their labels in every round and weigh as much as all documents together, so the hidden label
    stays the one that they have instead of becoming whatever splits the votes best, such as a language.
    """

    def labelled_moments(batches):
        total = np.zeros((2, voters.size + 1, voters.size + 1))
        for batch in shingles.small_batches(batches):
            full = np.hstack([voters.votes(batch), np.ones((batch.num_rows, 1))]).astype(float)
            y = np.array(batch.column("target").to_pylist())
            for k in (0, 1):
                total[k] += full[y == k].T @ full[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    total = np.zeros(2 * (voters.size + 1) ** 2)
    for r in rows.mapInArrow(labelled_moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    total = total.reshape(2, voters.size + 1, voters.size + 1)
    weight = total[:, -1, -1]
    prior = weight[1] / weight.sum() if weight.min() > 0 else 0.1
    model = LabelModel(prior, total[:, -1, :-1], total[:, :-1, :-1], weight)
    if weight.min() == 0:
        # No labels of one kind: a text is suspect in proportion to the voters that fire.
        m = voters.size
        one = np.stack([np.full(m, 0.02), np.full(m, 0.5)]) * 100
        model = LabelModel(prior, one, np.einsum("yi,yj->yij", one, one) / 100, np.array([100.0, 100.0]))
    patterns = cut_lineage(_pattern_counts(docs, voters))
    known = total if weight.min() > 0 else np.zeros_like(total)
    for _ in range(ROUNDS):
        singles, pairs, weight = _moments(patterns, voters.size, model)
        if weight.sum() == 0:
            break
        share = weight.sum() / max(1.0, known[:, -1, -1].sum())
        singles, pairs, weight = singles + share * known[:, -1, :-1], pairs + share * known[:, :-1, :-1], weight + share * known[:, -1, -1]
        model = LabelModel(weight[1] / weight.sum(), singles, pairs, weight)
    return model


#: Non-zero features that one step of a gradient looks at.
STEP_FEATURES = 1 << 19


def fit_logistic(indptr: np.ndarray, indices: np.ndarray, columns: int, target: np.ndarray, l2: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary sparse rows with soft targets, by accelerated gradient descent.

    The gradient of all rows is summed over slices of about STEP_FEATURES
    non-zero features, so the working arrays do not grow with the rows.
    """
    n = max(1, len(target))
    cuts = np.unique(np.searchsorted(indptr, np.arange(0, int(indptr[-1]) + STEP_FEATURES, STEP_FEATURES)).clip(0, len(target)))
    slices = [(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(target))) if b > a]
    w, b = np.zeros(columns), float(np.log((target.sum() + 0.5) / (n - target.sum() + 0.5)))
    momentum, scale = np.zeros(columns), np.zeros(columns)
    mb = sb = 0.0
    for t in range(1, steps + 1):
        grad, gb = l2 * w, 0.0
        for first, last in slices:
            own = indices[indptr[first] : indptr[last]]
            rows = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(indptr[first : last + 1]))
            z = np.bincount(rows, weights=w[own], minlength=last - first) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[first:last]) / n
            grad += np.bincount(own, weights=error[rows], minlength=columns)
            gb += error.sum()
        momentum, mb = 0.9 * momentum + 0.1 * grad, 0.9 * mb + 0.1 * gb
        scale, sb = 0.99 * scale + 0.01 * grad**2, 0.99 * sb + 0.01 * gb**2
        step = 0.1 / (1 + t / 100)
        w -= step * (momentum / (1 - 0.9**t)) / (np.sqrt(scale / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6)
    return w, b


class Scorer:
    """A linear classifier on votes and on the presence of vocabulary words."""

    def __init__(self, voters: Voters, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        self.voters, self.vocabulary, self.weights, self.bias = voters, vocabulary, weights, bias

    def scores(self, batch) -> np.ndarray:
        features = _features(batch)
        z = self.voters.votes(batch, features) @ self.weights[: self.voters.size] + self.bias
        rows, cols = _lookup(*features[:2], self.vocabulary)
        z += np.bincount(rows, weights=self.weights[self.voters.size :][cols], minlength=batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    chosen = training_labels(docs, labels, "toxic")
    rows = labelled_texts(docs, chosen)
    common = common_features(rows)
    sample = bounded_sample(chosen, train_rows)
    voters = Voters(mine_words(common, labelled_texts(docs, sample.where("target = 1"))))
    model = fit_label_model(docs, rows, voters)
    vocabulary = np.sort(np.array([c[0] for c in common[:VOCABULARY]], np.int64).view(np.uint64))

    def featurise(batches):
        for batch in shingles.small_batches(batches):
            features = _features(batch)
            votes = voters.votes(batch, features)
            row, col = _lookup(*features[:2], vocabulary)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            known = [(col[a:b] + voters.size).astype(np.uint16) for a, b in zip(bounds, bounds[1:])]
            own = [np.concatenate([np.flatnonzero(v).astype(np.uint16), k]).tobytes() for v, k in zip(votes, known)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(model.posterior(votes))], names=["columns", "posterior"])

    sample = labelled_texts(docs, sample).mapInArrow(featurise, "columns binary, posterior double").toArrow()
    # Two bytes a feature: voters and vocabulary together are fewer than 65,536.
    target, lengths, parts = sample["posterior"].to_numpy(), [], []
    for chunk in sample["columns"].chunks:
        data, offsets = shingles.text_bytes(chunk)
        lengths.append(np.diff(offsets) // 2)
        parts.append(data.view(np.uint16))
    del sample
    indptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))])
    indices = np.concatenate([np.zeros(0, np.uint16), *parts])
    del parts
    weights, bias = fit_logistic(indptr, indices, voters.size + len(vocabulary), target, RIDGE)
    return Scorer(voters, vocabulary, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in shingles.small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.value.scores(batch))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Input rows that are not predicted to be toxic, all columns kept."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in shingles.small_batches(batches):
            kept = batch.filter(pa.array(scorer.value.scores(batch) < THRESHOLD))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
