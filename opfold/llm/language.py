"""Language identification by cross-parsing entropy.

For each language a suffix automaton recognises every substring of its training
text. Cross-parsing cuts a text into phrases, each the longest match from where
the last one ended; the language whose text needs the fewest, normalised by the
bits of a position in the training text, wins. (Ziv and Merhav's measure of
cross entropy.)

The automata are completed to tables (state x byte class): a missing transition
goes to the root's and counts a phrase. Texts are laid out in segments of
``SEGMENT`` bytes and all segments of a batch step through a table together, a
byte at a time, in vectorised look-ups. A segment is first parsed as if a phrase
began there, then again from the state in which the one before it ends, until
both parses are in one state, which takes some tens of bytes; so phrases go on
over borders and the counts are those of the whole text, whatever its length.

Learning takes at most ``docs_per_language`` documents of each language (by
hash, of any length) and ``train_bytes`` bytes of them in pieces spread over
each text (parameters). The prediction is ``und`` for texts without a letter
(Unicode category L), null texts, or if nothing could be learnt. Equal costs go to
the language that sorts first. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opfold.llm.common import ASCII_LOWER, crc_mod

FOLDS, HELD, UNKNOWN = 4, 2, "und"
DOCS, TRAIN_BYTES, SEGMENT, LANES, MAX_LANGUAGES, PIECES = 200, 32 << 10, 256, 1 << 13, 256, 4
LETTER = regex.compile(r"\p{L}")
#: Letters lowered, bytes of longer characters kept, everything else one class.
FOLD = bytes(ASCII_LOWER[b] if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_automaton(codes: bytes) -> tuple[list[dict[int, int]], int]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step, len(codes)


class Parser:
    """The tables of all languages over a common alphabet of byte classes."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        folded = {n: texts[n].translate(FOLD) for n in self.names}
        alphabet = sorted(set(b" ").union(*folded.values()))
        self.width = len(alphabet) + 2  # one class for unseen bytes, one for the padding
        self.classes = bytes(alphabet.index(FOLD[b]) if FOLD[b] in alphabet else len(alphabet) for b in range(256))
        self.tables, self.bits = [], []
        for name in self.names:
            step, size = suffix_automaton(folded[name].translate(self.classes))
            lost = len(step)  # where an unseen byte leads: a phrase of its own
            table = np.full((len(step) + 1, self.width), -1, np.int32)
            for state, to in enumerate(step):
                table[state, list(to)] = list(to.values())
            first = np.where(table[0] >= 0, table[0], lost)
            table[0] = first  # the root is left once, at the start, without ending a phrase
            full = np.where(table >= 0, table * self.width, ~(first * self.width)[None, :]).astype(np.int32)
            full[:, -1] = 0
            self.tables.append(full.ravel())
            self.bits.append(np.log2(max(2, size)))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of phrases of every text in every language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // SEGMENT)
        own = np.repeat(np.arange(len(texts)), lanes)
        pad = bytes([self.width - 1])
        flat = np.frombuffer(b"".join(t.translate(self.classes).ljust(int(n) * SEGMENT, pad) for t, n in zip(texts, lanes, strict=True)), np.uint8).reshape(-1, SEGMENT)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        out[sizes > 0] = 1
        last = np.zeros(len(self.names), np.int32)  # the states in which the lanes before ended
        for at in range(0, len(flat), LANES):
            part = np.ascontiguousarray(flat[at : at + LANES].T).astype(np.int32)
            goes_on = np.concatenate([[at > 0 and own[at - 1] == own[at]], own[at + 1 : at + LANES] == own[at : at + LANES][:-1]])
            for k, table in enumerate(self.tables):
                ended, last[k] = self.lanes(table, part, goes_on, last[k])
                np.add.at(out[:, k], own[at : at + LANES], ended)
        return out

    @staticmethod
    def lanes(table: np.ndarray, part: np.ndarray, goes_on: np.ndarray, before: np.int32) -> tuple[np.ndarray, np.int32]:
        """Phrases that end in each lane, and the last lane's state; lanes that ``goes_on`` marks go on from the lane before (the first from ``before``)."""
        states, ends = np.empty_like(part), np.empty(part.shape, bool)
        state = np.zeros(part.shape[1], np.int32)
        for i, codes in enumerate(part):
            state = np.take(table, codes + state, out=states[i], mode="clip")
            ends[i] = state < 0
            state ^= state >> 31
        ended = ends.sum(axis=0)
        begun, follow = np.zeros(part.shape[1], np.int32), np.flatnonzero(goes_on)
        while len(follow):
            own = np.where(follow > 0, states[-1, follow - 1], before)
            follow, own = follow[own != begun[follow]], own[own != begun[follow]]
            begun[follow], active, state = own, follow, own
            for i in range(len(part)):
                state = np.take(table, part[i, active] + state)
                end = state < 0
                state ^= state >> 31
                ended[active] += end.astype(np.int64) - ends[i, active]
                apart = state != states[i, active]
                ends[i, active], states[i, active] = end, state
                active, state = active[apart], state[apart]
                if not len(active):
                    break
            follow = active + 1  # those after lanes whose end has changed
            follow = follow[follow < part.shape[1]]
            follow = follow[goes_on[follow]]
        return ended, states[-1, -1]

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits a byte of every non-empty text in every language."""
        return self.phrases(texts) * np.array(self.bits) / np.array([max(1, len(t)) for t in texts])[:, None]


def training_texts(docs: DataFrame, folds: int = FOLDS, held: int = HELD, docs_per_language: int = DOCS, train_bytes: int = TRAIN_BYTES) -> dict[str, bytes]:
    """Training text by language, from a bounded sample taken by hash; pieces of each document, so that all have a say and all of a text can."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    own = own.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    ranked = own.withColumn("__k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))).filter(F.col("__k") <= docs_per_language)
    n = F.length("text")
    apart = F.concat_ws(" ", *(F.substring("text", (n * F.lit((2 * k + 1) / (2 * PIECES))).cast("int") + 1, F.lit(train_bytes // PIECES)) for k in range(PIECES)))
    kept = ranked.select("lang", "__k", F.when(n > train_bytes, apart).otherwise(F.col("text")).alias("text"))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in kept.toLocalIterator():
        found.setdefault(r.lang, []).append((r["__k"], r.text.encode()))
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def pieces(text: bytes, share: int) -> bytes:
        size = -(-share // PIECES)
        return text if len(text) <= share else b" ".join(text[(2 * k + 1) * len(text) // (2 * PIECES) - size // 2 :][:size] for k in range(PIECES))

    return {lang: b" ".join(pieces(t, -(-train_bytes // len(texts))) for _, t in sorted(texts))[:train_bytes] for lang, texts in found.items()}


def languages(docs: DataFrame, folds: int = FOLDS, held: int = HELD, docs_per_language: int = DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, lang_pred and score of every document; the score is the winner's share of evidence over the runner-up."""
    spark = docs.sparkSession
    parser = spark.sparkContext.broadcast(Parser(training_texts(docs, folds, held, docs_per_language, train_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                known = [k for k, t in enumerate(texts) if p.names and t and LETTER.search(t)]
                names: list[str] = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                if known:
                    raw = pc.cast(part.column(1), pa.binary()).to_pylist()
                    cost = p.costs([raw[k] for k in known])
                    best = cost.argmin(axis=1)
                    low = cost[np.arange(len(known)), best]
                    other = np.partition(cost, 1, axis=1)[:, 1] if cost.shape[1] > 1 else 2 * low
                    for k, b in zip(known, best, strict=True):
                        names[k] = p.names[b]
                    scores[known] = 1 / (1 + np.exp(-np.clip(20 * (other - low) / other, 0, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
