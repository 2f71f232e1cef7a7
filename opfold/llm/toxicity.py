"""Toxicity by compression distance.

zstandard's trainer makes separate dictionaries: one from ordinary text, one
from toxic text. Ordinary text teaches twice, first a base from whole windows,
then what the base leaves unexplained; toxic text teaches what all of that
leaves unexplained (words with four or more bytes in no shared 5-gram), so that
the two sides differ by their own text and not by chance. A window of
consecutive words is compressed with the ordinary dictionaries and with the
toxic one before them; the bytes that the toxic one saves are the window's
evidence. A document's mean and largest savings and its windows over each of
several thresholds go through a logistic calibration, fitted on labelled
documents by dictionaries that did not see them (three folds) and weighted to
the labels' true shares.

Learning takes at most ``rows`` documents of each label that are in the table
(parameter) and of each at most ``most_windows`` windows, evenly spread over
the whole text; near copies among them teach once. Scoring reads whole texts in
windows, whatever their length. Null and empty texts score as a text without
evidence. Without labels of both kinds, or too little text to train from, the
score is the share of label 1 (0 if there are none). Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from opfold.llm.common import LOWER_AND_SPACES, labelled_sample, logistic, scored

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Bytes saved at which a window counts.
EVIDENCE = (1, 2, 3, 4, 6)
THIRDS = 3
ROWS, MOST_WINDOWS, WORDS, LEVEL = 2000, 1024, 12, 9
#: Sizes of the dictionaries, bytes.
BASE_BYTES, ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 32 << 10, 4 << 10
#: Bytes of a segment that the trainer takes, and bytes whose repetition it counts, for whole windows and for what is left.
WINDOW_SEGMENTS, REST_SEGMENTS = (64, 8), (24, 8)
GRAM, UNEXPLAINED, REST_BYTES = 5, 4, 4000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_AND_SPACES).split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]


def spread(text: bytes, most: int = MOST_WINDOWS) -> bytes:
    """The text, or ``most`` of its windows from its beginning to its end."""
    words = words_of(text)
    n = -(-len(words) // WORDS)
    if n <= most:
        return text
    return b" ".join(w for k in range(most) for w in words[k * n // most * WORDS : (k * n // most + 1) * WORDS])


def compressor(dictionary: bytes):
    """The bytes that a frame with that prefix takes, as a function."""
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(compression_level=LEVEL, window_log=17, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress


def trained(samples: list[bytes], size: int, segments: tuple[int, int]) -> bytes:
    """A dictionary by zstandard's trainer; of samples too few for it, the last of them."""
    samples = [s for s in samples if len(s) > 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segments[0], d=segments[1], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def unexplained(texts: list[list[bytes]], known: bytes) -> list[bytes]:
    """What is left of each text: its words with ``UNEXPLAINED`` bytes in no n-gram of ``known``."""
    grams = {known[i : i + GRAM] for i in range(len(known) - GRAM + 1)}
    judged: dict[bytes, bool] = {}

    def judge(word: bytes) -> bool:
        own = b" " + word + b" "
        covered = bytearray(len(own))
        for i in range(len(own) - GRAM + 1):
            if own[i : i + GRAM] in grams:
                covered[i : i + GRAM] = b"\1" * GRAM
        return covered.count(0) >= UNEXPLAINED

    out = []
    for words in texts:
        for w in words:
            if w not in judged:
                judged[w] = judge(w)
        out.append((b" " + b"  ".join(w for w in words if judged[w]) + b" ")[:REST_BYTES])
    return out


def signature(words: list[bytes]) -> tuple[int, int] | None:
    """The least and the largest hash of word pairs; near copies share one of them."""
    hashes = [xxhash.xxh64_intdigest(a + b" " + b, 7) for a, b in zip(words, words[1:], strict=False)]
    return (min(hashes), max(hashes)) if hashes else None


def unlike(texts: list[tuple[list[bytes], tuple[int, int] | None]]) -> list[list[bytes]]:
    """Texts without near copies, by their signatures."""
    seen: set[int] = set()
    out = []
    for words, mark in texts:
        if mark is None or seen & set(mark):
            continue
        seen.update(mark)
        out.append(words)
    return out


def dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    base = trained([w for words in ordinary[::2] for w in windows(words)], BASE_BYTES, WINDOW_SEGMENTS)
    plain = trained(unexplained(ordinary, base), ORDINARY_BYTES, REST_SEGMENTS) + base
    return plain, trained(unexplained(toxic, plain), TOXIC_BYTES, REST_SEGMENTS)


class Model:
    """Dictionaries and calibration; it is sent to the workers as bytes and numbers."""

    def __init__(self, ordinary: bytes, toxic: bytes, share: float):
        self.ordinary, self.toxic, self.share = ordinary, toxic, share
        self.weights = self.center = self.scale = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("plain", "marked")}

    def saved(self, text: bytes | None) -> list[int]:
        """Of every window, how many bytes shorter the toxic dictionary makes it."""
        if "plain" not in self.__dict__:
            self.plain, self.marked = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        plain, marked = self.plain, self.marked
        return [len(plain(w)) - len(marked(w)) for w in windows(words_of(text))]

    def evidence(self, text: bytes | None) -> tuple[float, ...]:
        saved = np.array(self.saved(text) or [0.0])
        n = len(saved)
        over = [float((saved >= t).sum()) for t in EVIDENCE]
        top = np.sort(saved)[::-1][:3]
        return min(3.0, max(-3.0, saved.mean())), min(np.clip(saved - 1, 0, None).mean(), 3.0), *np.log1p(over), *(np.array(over) / n), min(top[0], 12.0), min(top.sum(), 30.0), float(np.log1p(n))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (np.array([self.evidence(t) for t in texts]).reshape(len(texts), -1) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(sample: list[tuple[int, int, bytes]], counts: dict[int, int]) -> Model:
    """From (doc_id, label, text) rows and the number of labels of each value.

    The calibration sees every document by dictionaries of the other thirds of
    the sample; the model's own dictionaries are of the whole sample.
    """
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = sorted(sample, key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
    shared: dict[bytes, bytes] = {}  # a word is kept once, however many texts hold it
    texts = []
    for _, label, text in sample:
        words = [shared.setdefault(w, w) for w in words_of(text)]
        texts.append((label, (words, signature(words))))
    y = np.array([label for label, _ in texts], float)

    def without(held: int | None) -> list[list[list[bytes]]]:
        return [unlike([t for i, (label, t) in enumerate(texts) if label == k and (held is None or i % THIRDS != held)]) for k in (0, 1)]

    x: list = [None] * len(sample)
    for held in range(THIRDS):
        kinds = without(held)
        if not all(kinds):
            return Model(b"", b"", share)
        model = Model(*dictionaries(*kinds), share)
        for i in range(held, len(sample), THIRDS):
            x[i] = model.evidence(sample[i][2])
    seen = np.array(x)
    model = Model(*dictionaries(*without(None)), share)
    model.center, model.scale = seen.mean(axis=0), seen.std(axis=0) + 1e-9
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = logistic((seen - model.center) / model.scale, y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, rows: int = ROWS, most_windows: int = MOST_WINDOWS) -> Model:
    sample, counts = labelled_sample(docs, labels, label, folds, held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t.as_py(), most_windows) for t in pc.cast(batch.column(2), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "label", "text"])

    taken = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, text binary")
    return train([(r.doc_id, r.label, bytes(r.text)) for r in taken.toLocalIterator()], counts)


def scores_of(spark, model: Model):
    """A function of texts for the workers."""
    shared = spark.sparkContext.broadcast(model)
    return lambda texts: shared.value.scores(texts)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    return scored(docs, scores_of(docs.sparkSession, learn(docs, labels)))
