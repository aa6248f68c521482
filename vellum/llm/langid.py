"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability for each piece of a public vocabulary. The probability of a word is
the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward
pass over the word's end positions gives that sum without listing the cuts. A text's score is
the sum of its words' log-probabilities plus the log of the language's share in training.

Training is expectation maximisation on the word counts of all labelled documents that are not
held out. The counts are a table; each round, forward and backward passes over it give each
piece's expected count, and the driver gets one row a piece and language, whatever the corpus.
Expected counts are summed as whole multiples of 1 / UNIT, so that the order of the words makes
no difference. The vocabulary itself is taken as it is.

A document is typical of its language if its mean log-probability a letter is at least the
lowest of all training documents of that language, less MARGIN; of under SHORT letters always.

Cases: a text that is null or has no letters is `und` with score 0 and not typical; texts and
words of any length are scored whole (only training cuts words, at MAX_WORD letters); equal scores go to the first language in order; without any labelled document all texts
are `und`; repeated rows give repeated results; an empty table gives none; input columns that
have the names of outputs are replaced.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.secrets import slices
from vellum.plans.runtime import Scratch

#: The vocabulary's file; a parameter, since it is not part of this repository.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_WORD = 24
ROUNDS = 3
#: Words of a language that a training task goes through at a time.
HELD = 50_000
#: Parts of a word that expected counts are rounded to.
UNIT = 1 << 20
#: Letters below which a document's fit is not judged, and what it may fall below the training documents'.
SHORT, MARGIN = 100, 0.5
#: Probability of a character by itself if no piece has it, and the weight of smoothing.
CHAR_FLOOR, SMOOTHING = 1e-7, 0.1
MARK = "▁"
#: Edges of letters below this code point (Latin, Greek, Cyrillic) are in a dense table, others in a sorted one.
LETTERS_BELOW = 0x530


@functools.cache
def read_pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces of letters, lower case, with or without a leading word mark."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: name a sentencepiece model that the driver can read")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    letters = lambda p: p.removeprefix(MARK)
    return tuple(sorted(p for p in pieces if letters(p).isalpha() and p == p.lower()) + [MARK])


class Trie:
    """All pieces: edge[node * n_chars + char] -> node, piece[node] -> id or the id of none.

    Characters from n_chars on have their few edges in `far`, sorted by node * n_codes + char.
    """

    def __init__(self, pieces: tuple[str, ...]):
        far = lambda c: c != MARK and ord(c) >= LETTERS_BELOW
        self.chars = {c: i + 1 for i, c in enumerate(sorted(set("".join(pieces)), key=lambda c: (far(c), c)))}
        self.n_chars, self.n_codes, self.n_pieces = sum(not far(c) for c in self.chars) + 1, len(self.chars) + 1, len(pieces)
        self.depth = max(map(len, pieces))
        nodes: list[dict[int, int]] = [{}, {}]  # node 0 is dead, node 1 the root
        ids = {}
        for k, piece in enumerate(pieces):
            at = 1
            for c in piece:
                if (code := self.chars[c]) not in nodes[at]:
                    nodes[at][code] = len(nodes)
                    nodes.append({})
                at = nodes[at][code]
            ids[at] = k
        self.edge = np.zeros(len(nodes) * self.n_chars, np.int32)
        self.piece = np.full(len(nodes), self.n_pieces, np.int32)
        for at, to in enumerate(nodes):
            for code, node in to.items():
                if code < self.n_chars:
                    self.edge[at * self.n_chars + code] = node
        keyed = sorted((at * self.n_codes + code, node) for at, to in enumerate(nodes) for code, node in to.items() if code >= self.n_chars)
        self.far = np.array([k for k, _ in keyed], np.int64)
        self.far_node = np.array([node for _, node in keyed], np.int32)
        for at, k in ids.items():
            self.piece[at] = k
        self.code = np.zeros(max(map(ord, self.chars)) + 1, np.int32)
        for c, code in self.chars.items():
            self.code[ord(c)] = code

    def __getstate__(self) -> dict:
        """The edges there are in place of the dense table: some hundred KB for 39 MB, which every broadcast would leave on each machine's disk."""
        at = np.flatnonzero(self.edge)
        return self.__dict__ | {"edge": (len(self.edge), at, self.edge[at])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        size, at, node = state["edge"]
        self.edge = np.zeros(size, np.int32)
        self.edge[at] = node

    def words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the list, matrix of character codes with the mark first) by length, a bounded block at a time."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            where = np.flatnonzero(sizes == size)
            block = max(1, min(20_000, 300_000 // int(size)))
            for k in range(0, len(where), block):
                part = where[k : k + block]
                points = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                codes = self.code[np.where(points < len(self.code), points, 0)]
                yield part, np.concatenate([np.full((len(part), 1), self.chars[MARK], np.int32), codes], axis=1)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes reached by one character each, 0 where there is no edge."""
        far = code >= self.n_chars
        if not far.any():
            return self.edge[node * self.n_chars + code]
        out = self.edge[node * self.n_chars + np.where(far, 0, code)]
        key = node[far].astype(np.int64) * self.n_codes + code[far]
        at = np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)
        out[far] = np.where(self.far[at] == key, self.far_node[at], 0)
        return out

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece ids) of all pieces that occur in the words, by start."""
        n, size = codes.shape
        for s in range(size):
            rows, node = np.arange(n), np.ones(n, np.int32)
            for e in range(s, min(size, s + self.depth)):
                node = self.step(node, codes[rows, e])
                live = node > 0
                if not live.all():
                    rows, node = rows[live], node[live]
                if not len(rows):
                    break
                ids = self.piece[node]
                hit = ids < self.n_pieces
                if hit.any():
                    yield s, e + 1, rows[hit], ids[hit]


def forward(trie: Trie, codes: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: the summed probability of all segmentations up to a position.

    prob: [pieces, languages]. A single character may always stand alone with CHAR_FLOOR.
    """
    n, size = codes.shape
    alpha = np.zeros((size + 1, n, prob.shape[1]))
    alpha[0] = 1.0
    last = -1
    for s, e, rows, ids in trie.edges(codes):
        while last < s:  # all edges into this start are in
            last += 1
            if last:
                alpha[last] += alpha[last - 1] * CHAR_FLOOR
        alpha[e][rows] += alpha[s][rows] * prob[ids]
    while last < size:
        last += 1
        if last:
            alpha[last] += alpha[last - 1] * CHAR_FLOOR
    return alpha


def log_total(trie: Trie, codes: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """[words, languages]: the logarithm of the summed probability of all segmentations.

    Sums of long words are scaled at each position, so that they do not vanish.
    """
    n, size = codes.shape
    if size <= MAX_WORD:
        return np.log(forward(trie, codes, prob)[-1])
    alpha, logs, last = np.zeros((size + 1, n, prob.shape[1])), np.zeros((n, prob.shape[1])), 0
    alpha[0] = 1.0

    def settle(upto: int) -> None:
        nonlocal last, logs
        while last < upto:
            last += 1
            alpha[last] += alpha[last - 1] * CHAR_FLOOR
            scale = alpha[last].copy()
            alpha[last : last + trie.depth + 1] /= scale
            logs += np.log(scale)

    for s, e, rows, ids in trie.edges(codes):
        settle(s)
        alpha[e][rows] += alpha[s][rows] * prob[ids]
    settle(size)
    return logs


def backward(trie: Trie, codes: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, list]:
    n, size = codes.shape
    edges = list(trie.edges(codes))
    beta = np.zeros((size + 1, n, prob.shape[1]))
    beta[size] = 1.0
    by_start: dict[int, list] = {}
    for s, e, rows, ids in edges:
        by_start.setdefault(s, []).append((e, rows, ids))
    for s in range(size - 1, -1, -1):
        beta[s] += beta[s + 1] * CHAR_FLOOR
        for e, rows, ids in by_start.get(s, ()):
            beta[s][rows] += beta[e][rows] * prob[ids]
    return beta, edges


def expect(trie: Trie, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Each piece's expected count, in units of 1 / UNIT, in one language's words; prob: [pieces, 1]."""
    expected = np.zeros(trie.n_pieces, np.int64)
    for part, codes in trie.words(words):
        alpha = forward(trie, codes, prob)
        beta, edges = backward(trie, codes, prob)
        share = counts[part] / alpha[-1][:, 0]
        weights = [np.rint(alpha[s][rows, 0] * prob[ids, 0] * beta[e][rows, 0] * share[rows] * UNIT) for s, e, rows, ids in edges]
        if edges:
            expected += np.bincount(np.concatenate([ids for *_, ids in edges]), np.concatenate(weights), trie.n_pieces).astype(np.int64)
    return expected


def learn(counted: DataFrame, trie: Trie, languages: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """[pieces, languages] probabilities from a table of (lang, word, n)."""
    context = counted.sparkSession.sparkContext
    prob = np.full((trie.n_pieces, len(languages)), 1.0 / trie.n_pieces)
    shared = context.broadcast(trie)
    for _ in range(rounds if languages else 0):
        now = context.broadcast(prob)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            trie, prob = shared.value, now.value
            found, held = {}, {lang: ([], []) for lang in languages}

            def flush(lang: str) -> None:
                words, counts = held.pop(lang)
                held[lang] = [], []
                place = languages.index(lang)
                found[lang] = found.get(lang, 0) + expect(trie, words, np.array(counts, float), prob[:, place : place + 1])

            for batch in batches:
                for lang, w, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words, counts = held[lang]
                    for k in range(0, len(w), MAX_WORD):
                        words.append(w[k : k + MAX_WORD])
                        counts.append(c)
                    if len(words) >= HELD:
                        flush(lang)
            for lang in languages:
                flush(lang)
            for lang, expected in found.items():
                ids = np.flatnonzero(expected)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(expected[ids], pa.int64())], names=["lang", "piece", "units"])

        table = counted.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, units long").groupBy("lang", "piece").agg(F.sum("units").alias("units")).toArrow()
        expected = np.full(prob.shape, SMOOTHING)
        places = np.array([languages.index(x) for x in table["lang"].to_pylist()], np.int64)
        expected[np.asarray(table["piece"]), places] += np.asarray(table["units"]) / UNIT
        prob = expected / expected.sum(axis=0)
        now.destroy()
    shared.destroy()
    return prob


class Model:
    def __init__(self, trie: Trie, languages: list[str], prob: np.ndarray, prior: np.ndarray):
        self.trie, self.languages, self.prob, self.prior = trie, languages, prob, prior
        #: The least fit of a typical document of each language.
        self.floor: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """[words, languages] log-probabilities."""
        out = np.zeros((len(words), len(self.languages)))
        for part, codes in self.trie.words(words):
            out[part] = log_total(self.trie, codes, self.prob)
        return out

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The language of each text, its share of the posterior, its mean log-probability a letter, and the letters."""
        found, sizes = split_words(texts)
        names, best, fit, letters = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not len(found) or not self.languages:
            return names, best, fit, letters
        coded = found.dictionary_encode()
        log_p = self.words(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices)
        rows = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        letters[rows] = np.add.reduceat(np.asarray(pc.utf8_length(coded.dictionary)).astype(np.int64)[codes], starts)
        own = np.stack([np.add.reduceat(log_p[codes, k], starts) for k in range(log_p.shape[1])], axis=1)
        total = own + self.prior
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        top = share.argmax(axis=1)
        best[rows] = np.minimum(share[np.arange(len(rows)), top], 1.0)
        fit[rows] = own[np.arange(len(rows)), top] / letters[rows]
        for r, k in zip(rows, top, strict=True):
            names[r] = self.languages[k]
        return names, best, fit, letters


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words (runs of letters, lower case) one after another, and how many each text has."""
    texts = pc.coalesce(texts.cast(pa.string()), pa.scalar(""))
    spaced = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL]+", " "))
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    filled = pc.not_equal(flat, "")  # a text without letters splits into one empty word
    empty = np.asarray(pc.equal(spaced, "")) | np.asarray(pc.equal(spaced, " "))
    return flat.filter(filled), np.where(empty, 0, sizes)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, vocabulary: str = VOCABULARY, floors: bool = True) -> Model:
    """A model from all labelled documents that are not held out; floors=False leaves out what only `typical` needs."""
    trained = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    n = {r["lang"]: r["count"] for r in trained.groupBy("lang").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, texts = batch.column(0), batch.column(1)
            found, sizes = split_words(texts)
            table = pa.table({"lang": pa.array(np.repeat(np.asarray(langs), sizes), pa.string()), "word": found.cast(pa.string())})
            yield from table.group_by(["lang", "word"]).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"]).to_batches()

    scratch = Scratch(docs.sparkSession, "language")
    counted = scratch.save(trained.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).sortWithinPartitions("lang"), "words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    trie = Trie(read_pieces(vocabulary))
    prob = learn(counted, trie, languages)
    scratch.drop(counted)
    prior = np.log(np.array([n[x] for x in languages], float) / max(1, sum(n[x] for x in languages)))
    model = Model(trie, languages, prob, prior)
    if floors and languages:
        own = predict(trained, model, keep=("lang",)).where((F.col("lang_pred") == F.col("lang")) & (F.col("letters") >= SHORT))
        model.floor = {r["lang"]: r["least"] - MARGIN for r in own.groupBy("lang").agg(F.min("fit").alias("least")).collect()}
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred, score, fit, letters and typical. The model's size is the vocabulary's times the languages', a few MB."""
    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType()), T.StructField("letters", T.LongType()), T.StructField("typical", T.BooleanType())]
    kept = [c for c in keep if c not in [f.name for f in own]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A text that is kept is not sent twice.
    source = docs.select(*kept, *([] if text in kept else [F.col(text).cast("string").alias("_text")]))
    read = text if text in kept else "_text"
    place = source.columns.index(read)
    schema = T.StructType([*[source.schema[c] for c in kept], *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = shared.value.floor
        for batch in slices(batches, read):
            names, best, fit, letters = shared.value.score(batch.column(place))
            typical = [n > 0 and (n < SHORT or f >= floor.get(name, -np.inf)) for name, f, n in zip(names, fit.tolist(), letters.tolist(), strict=True)]
            columns = [pa.array(names, pa.string()), pa.array(best), pa.array(fit), pa.array(letters), pa.array(typical, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, names=schema.names)

    return source.mapInArrow(run, schema)
