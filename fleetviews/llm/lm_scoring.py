"""Document probability under a subword lattice.

Pieces come from an existing vocabulary. A word, led by a blank, may be cut into pieces in many
ways; a forward recursion in log space over its bytes sums the probability of all of them. Single
bytes are pieces too, so every text has a probability. Each word seen in training is an arc of its
own across the whole word, beside the pieces: with count c of N tokens, V of them distinct, it
weighs (c - d) / N, and the pieces share the d * V / N that is left. A document is its words and one
end, so its log probability is the sum of theirs: the marginal over every segmentation.

A document also has a class, as words of one language keep together. The classes are the up to
``CLASSES`` languages with most training documents, and one for all languages. In a class with N_k
tokens, V_k of them distinct, the arc of a word counted c_k times weighs (c_k - d) / N_k, and the
d * V_k / N_k that is left goes to the pieces (``TO_PIECES`` of it) and to the lattice of all languages.
The class is not read from the document: its score is the log of the mean of its probabilities under
all classes, so it is the marginal over class and segmentation.

The vocabulary's scores (merge ranks) give the pieces their first weights, falling with the rank.
Expected piece counts over the training words then replace them (expectation maximisation,
``ROUNDS`` times), with the first weights as a prior of ``PRIOR`` pieces; each distinct word counts
once, since pieces are there for the words that training has not seen. Words are counted over the
whole training part; counts stay distributed. Only the pieces' weights (as many as the vocabulary
has) and the ``COMMON`` most frequent words of at most ``SHORT`` bytes are broadcast; counts of all
other words are joined. In training alone, words beyond ``LONG`` bytes count as parts of that length.

Null and empty texts have one token, the end. A null id counts as empty text for the fold and is
trained on. A document without a language trains the class of all. Rows that repeat an id are documents
of their own. An empty table gives an empty result; without training rows every count is zero. Other
columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

FOLDS = 5
HELD_OUT = 1
ROUNDS = 2
PRIOR = 1000.0
COMMON = 1 << 17
SHORT = 64
LONG = 512
#: What each arc of a whole word gives up for the pieces.
DISCOUNT = 0.75
#: Languages that are classes of their own; the model grows with them.
CLASSES = 16
TO_PIECES = 0.75
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
CELLS = 400_000
#: Probabilities below this are added up as logarithms.
TINY = 1e-250


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a leading blank marking the start of a word, and their first log weights."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    found: dict[bytes, float] = {}
    for number in range(size):
        if model.is_control(number) or model.is_unknown(number):
            continue
        if model.is_byte(number):
            piece, rank = bytes([int(model.id_to_piece(number)[3:5], 16)]), size
        else:
            piece, rank = model.id_to_piece(number).replace("▁", " ").encode(), -model.get_score(number)
        if piece != piece.lower() or b" " in piece[1:]:
            continue  # never part of a lower-cased word
        found[piece] = found.get(piece, 0.0) + 1 / (rank + 10)
    pieces = sorted(found)
    weights = np.array([found[p] for p in pieces])
    return pieces, np.log(weights / weights.sum())


class Lattice:
    """Sums over the segmentations of words, many words at a time."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray):
        self.weights = {p: float(w) for p, w in zip(pieces, log_weights)}
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(self.BASE, i, 1 << 64) for i in range(LONG + 2)], np.uint64)
        # A piece's code has its leading bits set here; most substrings are sorted out by them.
        self.sieve, self.tables = np.zeros(1 << 22, bool), {}
        for length in sorted({len(p) for p in pieces}):
            places = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            matrix = np.frombuffer(b"".join(pieces[i] for i in places), np.uint8).reshape(-1, length)
            codes = self._prefixes(matrix)[:, -1]
            order = np.argsort(codes)
            self.tables[length] = (codes[order], places[order])
            self.sieve[codes >> np.uint64(42)] = True
        self.log_weights = log_weights

    def _prefixes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        for at in range(words.shape[1]):
            out[:, at + 1] = out[:, at] * np.uint64(self.BASE) + words[:, at] + np.uint64(1)
        return out

    def _hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length: rows, starts and pieces of all substrings that are pieces."""
        prefixes, n = self._prefixes(words), words.shape[1]
        for length, (codes, places) in self.tables.items():
            if length <= n:
                code = prefixes[:, length:] - prefixes[:, : n + 1 - length] * self.powers[length]
                rows, starts = np.nonzero(self.sieve[code >> np.uint64(42)])
                found = code[rows, starts]
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                hit = codes[at] == found
                if hit.any():
                    yield length, rows[hit], starts[hit], places[at[hit]]

    def _logs(self, hits, n: int, rows: int) -> dict[int, np.ndarray]:
        """By length the log weight of every substring, minus infinity for none; one column a word."""
        out = {}
        for length, places, starts, pieces in hits:
            out[length] = np.full((n + 1 - length, rows), -np.inf)
            out[length][starts, places] = self.log_weights[pieces]
        return out

    @staticmethod
    def _forward(logs: dict[int, np.ndarray], n: int, rows: int) -> np.ndarray:
        out = np.full((n + 1, rows), -np.inf)
        out[0] = 0
        for end in range(1, n + 1):
            for length, weights in logs.items():
                if length <= end:
                    np.logaddexp(out[end], weights[end - length] + out[end - length], out=out[end])
        return out

    @staticmethod
    def _backward(logs: dict[int, np.ndarray], n: int, rows: int) -> np.ndarray:
        out = np.full((n + 1, rows), -np.inf)
        out[n] = 0
        for start in range(n - 1, -1, -1):
            for length, weights in logs.items():
                if start + length <= n:
                    np.logaddexp(out[start], weights[start] + out[start + length], out=out[start])
        return out

    @staticmethod
    def _by_length(words: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and byte matrix of words of one length, in pieces of bounded size."""
        groups: dict[int, list[int]] = {}
        words = list(words)
        for place, word in enumerate(words):
            groups.setdefault(len(word), []).append(place)
        for length, places in groups.items():
            each = max(1, CELLS // (length * min(length, 24)))
            for at in range(0, len(places), each):
                part = places[at : at + each]
                yield np.array(part), np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, length)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """The natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        long_ = [i for i, w in enumerate(words) if len(w) >= LONG]
        for i in long_:
            out[i] = self.log_probability(words[i])
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for places, matrix in self._by_length(b" " + words[i] for i in short):
            rows, n = matrix.shape
            out[np.array(short)[places]] = self._forward(self._logs(self._hits(matrix), n, rows), n, rows)[n]
        return out

    def log_probability(self, word: bytes) -> float:
        """The same for one word of any length, holding only the last piece's worth of positions."""
        data, window = b" " + word, [0.0]
        for end in range(1, len(data) + 1):
            terms = []
            for back in range(1, min(end, self.longest, len(window)) + 1):
                weight = self.weights.get(data[end - back : end])
                if weight is not None:
                    terms.append(weight + window[-back])
            most = max(terms)
            window.append(most + math.log(sum(math.exp(t - most) for t in terms)))
            if len(window) > self.longest:
                del window[0]
        return window[-1]

    def expected(self, words: list[bytes], counts: list[int], out: np.ndarray) -> None:
        """Adds the expected number of times each piece is used."""
        parts, times = [], []
        for word, count in zip(words, counts):
            data = b" " + word
            for at in range(0, len(data), LONG):
                parts.append(data[at : at + LONG])
                times.append(count)
        times = np.array(times, float)
        for places, matrix in self._by_length(parts):
            whole = self._add_expected(matrix, times[places], out)
            if (rest := whole < TINY).any():
                self._add_expected_logs(matrix[rest], times[places][rest], out)

    def _add_expected(self, matrix: np.ndarray, times: np.ndarray, out: np.ndarray) -> np.ndarray:
        """In plain numbers, for the words that are not too improbable for them; returns probabilities."""
        rows_, n = matrix.shape
        hits = list(self._hits(matrix))
        dense = {}
        for length, rows, starts, pieces in hits:
            dense[length] = np.zeros((n + 1 - length, rows_))
            dense[length][starts, rows] = np.exp(self.log_weights[pieces])
        forward, backward = np.zeros((n + 1, rows_)), np.zeros((n + 1, rows_))
        forward[0] = backward[n] = 1
        for end in range(1, n + 1):
            for length, weights in dense.items():
                if length <= end:
                    forward[end] += weights[end - length] * forward[end - length]
        for start in range(n - 1, -1, -1):
            for length, weights in dense.items():
                if start + length <= n:
                    backward[start] += weights[start] * backward[start + length]
        whole = forward[n]
        share = np.divide(times, whole, out=np.zeros(rows_), where=whole >= TINY)
        for length, rows, starts, pieces in hits:
            part = forward[starts, rows] * dense[length][starts, rows] * backward[starts + length, rows] * share[rows]
            out += np.bincount(pieces, part, minlength=len(out))
        return whole

    def _add_expected_logs(self, matrix: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        rows_, n = matrix.shape
        hits = list(self._hits(matrix))
        logs = self._logs(hits, n, rows_)
        forward, backward = self._forward(logs, n, rows_), self._backward(logs, n, rows_)
        for length, rows, starts, pieces in hits:
            part = forward[starts, rows] + logs[length][starts, rows] + backward[starts + length, rows] - forward[n, rows]
            out += np.bincount(pieces, np.exp(part) * times[rows], minlength=len(out))


def _words(text) -> list[bytes]:
    return text.as_buffer().to_pybytes().lower().split()  # bytes: A-Z only, the six spaces only


def classes(rows: DataFrame, most: int = CLASSES) -> list[str]:
    """The languages of most training documents, ``most`` of them."""
    found = rows.filter("NOT held_out AND lang IS NOT NULL").groupBy("lang").count()
    return [r.lang for r in found.orderBy(F.col("count").desc(), "lang").limit(most).collect()]


def word_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """word, n and n_class over the binary column ``text``: all words, how often training has them, and
    how often in each language. The empty word is the end of a document."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        # One counter a language, the last for all others and for words that are only looked up.
        held: list[Counter[bytes]] = [Counter() for _ in range(len(place) + 1)]

        def batches_of():
            for i, counter in enumerate(held):
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(counter), pa.binary()),
                            pa.array([i] * len(counter), pa.int32()),
                            pa.array(list(counter.values()), pa.int64()),
                        ],
                        ["word", "class", "n"],
                    )
                    counter.clear()

        for batch in batches:
            columns = (batch.column("text"), batch.column("held_out").to_pylist(), batch.column("lang").to_pylist())
            for text, held_out, lang in zip(*columns):
                words = _words(text)
                if held_out:
                    held[-1].update(dict.fromkeys([*words, b""], 0))
                else:
                    counter = held[place.get(lang, -1)]
                    counter.update(words)
                    counter[b""] += 1
                if sum(map(len, held)) >= HELD_WORDS:
                    yield from batches_of()
        yield from batches_of()

    counted = rows.select("text", "held_out", "lang").mapInArrow(run, "word binary, class int, n long")
    by_class = [F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)) for i in range(len(langs))]
    return counted.groupBy("word").agg(
        F.sum("n").alias("n"), F.array(*by_class).cast("array<bigint>").alias("n_class")
    )


def trained(words: DataFrame, pieces: list[bytes], first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces, and of the end in place of a word."""
    spark = words.sparkSession
    leading = np.array([p.startswith(b" ") for p in pieces])

    def ended(log_weights: np.ndarray, end: float) -> float:
        # After a word comes a piece with a blank, or the end: all that is no continuation.
        return math.log(end / (end + np.exp(log_weights[leading]).sum()))

    log_weights, log_end = first, ended(first, 1 / PRIOR)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, log_weights))

        def run(batches, model=model):
            names, weights = model.value
            lattice, total = Lattice(names, weights), np.zeros(len(names))
            for batch in batches:
                lattice.expected(
                    [w.as_buffer().to_pybytes() for w in batch.column("word")], [1] * batch.num_rows, total
                )
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        found = words.filter(F.length("word") > 0).select("word").mapInArrow(run, "piece long, n double")
        counts = np.exp(first) * PRIOR
        for piece, n in found.groupBy("piece").agg(F.sum("n")).collect():  # no more rows than the vocabulary
            counts[piece] += n
        whole = counts.sum() + 1  # the end is one more word
        log_weights = np.log(counts / whole)
        log_end = ended(log_weights, 1 / whole)
    return log_weights, log_end


def _with_pieces(words: DataFrame, model) -> DataFrame:
    """``words`` with the common logarithm of the probability that the pieces give the word."""

    def run(batches):
        names, weights, end = model.value
        lattice = Lattice(names, weights)
        for batch in batches:
            found = [w.as_buffer().to_pybytes() for w in batch.column("word")]
            logs = lattice.log_probabilities(found)
            logs[[i for i, w in enumerate(found) if not w]] = end
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("word", "n", "n_class")), pa.array(logs / math.log(10))],
                ["word", "n", "n_class", "pieces"],
            )

    return words.select("word", "n", "n_class").mapInArrow(
        run, "word binary, n long, n_class array<bigint>, pieces double"
    )


def _word_scores(totals: list[tuple[int, int]]) -> list[Column]:
    """Common logarithm of a word's probability over all languages and in each class, from n, n_class and
    pieces; ``totals`` has tokens and distinct tokens in that order."""
    (tokens, distinct), *parts = totals
    n, by_pieces = F.col("n"), F.pow(F.lit(10.0), F.col("pieces"))
    share = DISCOUNT * distinct / tokens if tokens else 1.0  # of the pieces
    every = F.when(n > 0, (n - DISCOUNT) / float(tokens or 1)).otherwise(0.0) + share * by_pieces
    # Unseen words stay logarithms, since the probability of a long one is no number any more.
    unseen = F.col("pieces") + math.log10(share or 1.0)
    out = [F.when(n > 0, F.log10(every)).otherwise(unseen)]
    unseen_part = F.col("pieces") + math.log10(TO_PIECES + (1 - TO_PIECES) * share)
    for place, (tokens_k, distinct_k) in enumerate(parts):
        n_k, left = F.col("n_class")[place], DISCOUNT * distinct_k / tokens_k
        arc = F.when(n_k > 0, (n_k - DISCOUNT) / float(tokens_k)).otherwise(0.0)
        seen = F.log10(arc + left * ((1 - TO_PIECES) * every + TO_PIECES * by_pieces))
        out.append(F.when(n > 0, seen).otherwise(unseen_part + math.log10(left)))
    return out


def scores(
    docs: DataFrame, key: str, path: str, rounds: int = ROUNDS, common_words: int = COMMON, most_classes: int = CLASSES
) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT).alias("held_out"),
        F.col("lang").cast("string").alias("lang"),
        common.text_of().cast("binary").alias("text"),
    )
    langs = classes(rows, most_classes)
    counted = common.saved(word_counts(rows, langs), "words")

    def total(n: Column) -> Column:
        return F.struct(F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.count_if(n > 0).alias("distinct"))

    parts = [F.col("n"), *[F.col("n_class")[i] for i in range(len(langs))]]
    totals = [tuple(x) for x in counted.agg(*[total(n).alias(f"total_{i}") for i, n in enumerate(parts)]).first()]
    tokens, distinct = totals[0]
    pieces, first = vocabulary(path)
    model = spark.sparkContext.broadcast((pieces, *trained(counted.filter("n > 0"), pieces, first, rounds)))
    words = common.saved(_with_pieces(counted, model), "word-pieces")
    n = F.col("n")
    base = F.log10(n + 0.5) - F.lit(math.log10(tokens + 0.5 * (distinct + 1)))
    in_class = _word_scores(totals)
    frequent = words.filter((F.length("word") <= SHORT) & (n > 0)).orderBy(n.desc(), "word").limit(common_words)
    listed = frequent.select("word", F.array(base, *in_class).alias("scores")).collect()
    known = spark.sparkContext.broadcast(
        ({bytes(r.word): i for i, r in enumerate(listed)},
         np.array([r.scores for r in listed]).reshape(len(listed), 1 + len(in_class)))
    )

    def run(batches):
        index, values = known.value
        for batch in batches:
            out = [[] for _ in range(5)]
            for text in batch.column("text"):
                count = Counter(_words(text))
                count[b""] = 1
                places = [(index.get(word, -1), times) for word, times in count.items()]
                rest = [{"word": w, "times": t} for (i, t), w in zip(places, count) if i < 0]
                found = np.array([p for p in places if p[0] >= 0], np.int64).reshape(-1, 2)
                base_sum, *sums = (found[:, 1] @ values[found[:, 0]]).tolist()
                for column, value in zip(out, (count.total(), int(found[:, 1].sum()), base_sum, sums, rest)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()),
                     pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "doc_id", "held_out")), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["key", "doc_id", "held_out", "n_tokens", "hits", "base", "scores", "rest"],
            )

    scored = common.saved(
        rows.drop("lang").mapInArrow(
            run, "key long, doc_id long, held_out boolean, n_tokens long, hits long, base double,"
            " scores array<double>, rest array<struct<word: binary, times: long>>"
        ),
        "scored",
    )
    times = F.col("times")
    found = scored.select("key", F.inline("rest")).join(words, "word").groupBy("key").agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("more_hits"),
        F.sum(times * base).alias("more_base"),
        *[F.sum(times * score).alias(f"more_{i}") for i, score in enumerate(in_class)],
    )
    of_class = [
        F.col("scores")[i] + F.coalesce(F.col(f"more_{i}"), F.lit(0.0)) for i in range(len(in_class))
    ]
    joined = scored.drop("rest").join(found, "key", "left").select("*", F.array(*of_class).alias("of_class"))
    best = F.array_max("of_class")
    beside = F.aggregate("of_class", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - best))
    return joined.select(
        "key", "doc_id", "held_out", "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (best + F.log10(beside / float(len(in_class)))).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return scores(docs, key, public_tokenizers.path("piece_bpe_32k.model")).drop("key")
