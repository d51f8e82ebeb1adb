"""SentencePiece encoding and decoding by shared-prefix forward search.

Distinct marked words are sorted into a trie, which is walked depth first; the forward state of a prefix is worked out
once for all words that share it. For unigram models that state is the best score and its last piece (Viterbi). For BPE
models best scores give wrong ids, so the state is the last piece of the prefix's own encoding instead: the one piece
that ends there and is compatible with the state before it, compatible meaning that the two pieces' joint text is
encoded as just these two. Ids equal those of the reference library for both kinds of model.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG, MOST_CACHED, DOCS_AT_ONCE = 100, 200_000, 400


def load(path: str = MODEL) -> dict:
    """A model's pieces, read on the driver; the result is a plain value that tasks take along (about 1 MB)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.vocab_size()
    pieces = [p.id_to_piece(i) for i in range(n)]
    special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
    byte = [p.is_byte(i) for i in range(n)]
    normal = [not s and not b for s, b in zip(special, byte, strict=True)]
    if any(ok and MARK in piece.lstrip(MARK) for piece, ok in zip(pieces, normal, strict=True)):
        raise ValueError("pieces that hold a mark after other characters can't be split into marked words")
    scores = [p.get_score(i) for i in range(n)]
    kept = [scores[i] for i in range(n) if normal[i]]
    bpe = all(float(s).is_integer() for s in kept)
    return {"pieces": pieces, "scores": scores, "normal": normal, "byte": byte, "unk": p.unk_id(), "bpe": bpe}


class Codec:
    """Encodes and decodes with a loaded model. Not shared between tasks; caches are bounded."""

    def __init__(self, model: dict):
        self.pieces, self.scores, self.bpe, self.unk = model["pieces"], model["scores"], model["bpe"], model["unk"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if model["normal"][i]}
        # every end of a piece: 1 if it is a piece itself that merging can reach, else 0
        self.tails = dict.fromkeys((p[k:] for p in self.ids for k in range(len(p))), 0)
        self.tails.update((p, 1) for p in self.ids if not self.bpe or self.merged(p) == [p])
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model["byte"][i]}
        self.least = min(self.scores[i] for i in self.ids.values()) - 10
        self.raw = [bytes([int(p[1:-1], 16)]) if model["byte"][i] else (p.replace(MARK, " ").encode() if model["normal"][i] else b" \xe2\x81\x87 " if i == self.unk else b"") for i, p in enumerate(self.pieces)]
        self.fits: dict[tuple[str, str], bool] = {}  # of pairs of pieces
        self.cache: dict[str, array] = {}
        self.older: dict[str, array] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again: what the compatibility of pairs rests on."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether a prefix that ends with piece ``a`` (empty: none) may go on with ``b``; kept in ``fits``."""
        if len(self.fits) > 400_000:
            self.fits.clear()
        found = self.fits[a, b] = a not in self.ids or self.merged(a + b) == [a, b]
        return found

    def segment(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word; ``words`` are distinct. Walks the trie of the sorted words depth first."""
        out, ids, tails, scores, fits = {}, self.ids, self.tails, self.scores, self.fits
        last: list[str] = [""]  # the last piece of the prefix's best segmentation
        best: list[float] = [0.0]
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                pick = piece = word[start]
                if self.bpe:
                    while (kind := tails.get(piece)) is not None:
                        if kind:
                            prior = last[start]
                            found = fits.get((prior, piece))
                            if found or found is None and self.compatible(prior, piece):
                                pick = piece
                                break
                        if not start:
                            break
                        start -= 1
                        piece = word[start:end]
                else:
                    top = best[start] + (scores[ids[pick]] if pick in ids else self.least)
                    while start and word[start - 1 : end] in tails:
                        start -= 1
                        i = ids.get(word[start:end])
                        if i is not None and (score := best[start] + scores[i]) > top:
                            pick, top = word[start:end], score
                    best.append(top)
                last.append(pick)
            end, parts = len(word), []
            while end:
                parts.append(last[end])
                end -= len(last[end])
            out[word] = parts[::-1]
            before = word
        return out

    def to_ids(self, parts: list[str]) -> array:
        try:
            return array("i", [self.ids[p] for p in parts])
        except KeyError:
            out = array("i")
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[x] for x in p.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def encode(self, texts: list[str | None]) -> list[array]:
        """Ids of whole texts (null or empty: none)."""
        split = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > MOST_CACHED:  # words met again since then move on to the new generation
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        fresh = set().union(*split) - cache.keys()
        again = fresh & older.keys()
        for w in again:
            cache[w] = older[w]
        fresh -= again
        for w, parts in self.segment(list(fresh)).items():
            cache[w] = self.to_ids(parts)
        out = []
        for words in split:
            ids = array("i")
            for w in words:
                ids.extend(cache[w])
            out.append(ids)
        for w in fresh:
            if len(w) > LONG:
                del cache[w]
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, ids, decoded_equal)``.

    decoded_equal tells whether decoding the ids gives the text back: true for all texts but those that hold the mark
    U+2581 itself, which decodes as a space. Null and empty texts have no ids. Rows are handled one by one, so repeated
    rows and ids don't matter; a text of any length is encoded whole. Other columns are ignored.
    """

    def work(batches):
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                equal = [codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                flat = array("i")
                for x in ids:
                    flat.extend(x)
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.frombuffer(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), lists, pa.array(equal)], names=["doc_id", "n_tokens", "ids", "decoded_equal"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids array<int>, decoded_equal boolean")


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """``encoded(doc_id, ids)`` -> ``(doc_id, text)``; null ids give an empty text."""

    def work(batches):
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), load())
