"""Encoding of a corpus with a public byte-level BPE tokenizer, by merge replay over the words of the corpus.

Merges are not applied text by text. The words of the whole corpus are counted, and its MOST frequent ones (those that come more than
once) are encoded once for all documents: they are laid out in one array, an inverted index leads from each pair of neighbouring
tokens to the positions where it stands, and the merges are replayed in rank order, each one at all its positions, while only the
neighbours of a merged position are updated. As the token that a merge makes is part of later merges only, this gives each word the
tokens that the greedy rule gives it. The words' ids are sent to all tasks, and documents are put together where they lie. The rest
of the words, rarer than all of these, are replayed in the same way with the other such words of their partition: sending every one of them
to its word's task and back would move the documents twice.

Special tokens' strings are ordinary text; a null or empty text gives an empty list; long texts are encoded whole.
The vocabulary file's path is a parameter; the driver reads it and sends it to the tasks.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: What merges may not cross, as the vocabulary's publishers give it (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside the blocks where this pattern and the library's own cutting are known to agree (they differ in what newer
#: versions of Unicode have added). A text with such a character is cut by the library.
UNSURE = r"[^\u0000-\u0557\u0900-\u0BFF\u1E00-\u2070\u20A0-\u20BF\u2100-\u2BFF\u3000-\u9FFC\uAC00-\uD7A3\uF900-\uFAFF\uFE00-\uFE0F\uFEFF\uFF00-\uFFFD\U0001F300-\U0001F64F]"
#: Words of the corpus that are encoded once for all tasks, none longer than LONGEST characters.
MOST, LONGEST = 100_000, 64
#: Words that a task remembers; then it forgets the rare ones and goes on.
REMEMBERED = 1_000_000


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class MergeReplay:
    """Encoder of words with the merges of one vocabulary (JSON of the ``tokenizers`` library)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        spec["added_tokens"] = []
        self._library = Tokenizer.from_str(json.dumps(spec)).pre_tokenizer
        self._words, self._unsure = regex.compile(WORDS).findall, regex.compile(UNSURE).search
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in _byte_alphabet()]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # a pair of token ids as one number -> (rank, id of the merged token)
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.corpus: dict[str, list[int]] = {}  # words encoded for all tasks
        self.known: dict[str, list[int]] = {}  # these and the rare words met so far

    def learn(self, corpus: dict[str, list[int]]) -> None:
        if corpus is not self.corpus:
            self.corpus, self.known = corpus, dict(corpus)

    def cut(self, text: str) -> list[str]:
        """The words of a text; together they are the text."""
        if self._unsure(text):
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self._words(text)

    def replay(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        byte_ids, merges = self.byte_ids, self.merges
        tok: list[int] = []
        begin: list[int] = []
        for w in words:
            begin.append(len(tok))
            tok.extend([byte_ids[c] for c in w.encode()])
            tok.append(-1)  # the end of a word
        n = len(tok)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = defaultdict(list)
        for i in range(n - 1):
            if tok[i] >= 0 and tok[i + 1] >= 0:
                pair = tok[i] << 32 | tok[i + 1]
                if pair in merges:
                    where[pair].append(i)
        queue = [(merges[p][0], p) for p in where]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            a, b, made = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            fresh = set()
            for i in sorted(where.pop(pair)):
                if tok[i] != a:
                    continue
                j = nxt[i]
                if tok[j] != b:
                    continue
                k = nxt[j]
                tok[i], tok[j], nxt[i], prev[k] = made, -2, k, i
                h = prev[i]
                if h >= 0 and tok[h] >= 0:
                    p = tok[h] << 32 | made
                    if p in merges:
                        where[p].append(h)
                        fresh.add(p)
                if tok[k] >= 0:
                    p = made << 32 | tok[k]
                    if p in merges:
                        where[p].append(i)
                        fresh.add(p)
            for p in fresh:
                heapq.heappush(queue, (merges[p][0], p))
        out = []
        for i in begin:
            ids = []
            while tok[i] >= 0:
                ids.append(tok[i])
                i = nxt[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """All texts' ids one after the other, and the number of ids of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = dict(self.corpus)
        cut = [self.cut(t) if t else () for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.replay(new)))
        flat: list[int] = []
        sizes = []
        for ws in cut:
            at = len(flat)
            flat.extend(chain.from_iterable(map(known.__getitem__, ws)))
            sizes.append(len(flat) - at)
        return flat, sizes


_encoders: dict[int, MergeReplay] = {}  # of a Python worker


def _encoder(vocabulary: str) -> MergeReplay:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = MergeReplay(vocabulary)
    return _encoders[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Characters of text that are encoded together.
CHUNK = 2_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def corpus_words(df: DataFrame, text: str, vocabulary: Broadcast) -> dict[str, list[int]]:
    """The MOST frequent words of all texts, each with its ids. Words are counted where they lie before they are sent."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _encoder(vocabulary.value).cut
        for batch in batches:
            n = Counter(chain.from_iterable(cut(t) for t in batch.column(0).to_pylist() if t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        words = list(chain.from_iterable(b["word"].to_pylist() for b in batches))  # a part of MOST
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(enc.replay(words), pa.list_(pa.int32()))], ["word", "ids"])

    counts = df.select(F.col(f"`{text}`")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = counts.filter((F.col("n") > 1) & (F.length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(MOST)
    return {r.word: list(r.ids) for r in often.select("word").repartition("word").mapInArrow(replay, "word string, ids array<int>").collect()}


def _map(df: DataFrame, text: str, path: str, field: str, kind: str, build) -> DataFrame:
    rest = [f for f in df.schema.fields if f.name not in (text, field)]
    names = [f.name for f in rest]
    send = df.sparkSession.sparkContext.broadcast
    vocabulary = send(read_vocabulary(path))
    corpus = send(corpus_words(df, text, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        enc.learn(corpus.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in _chunks(texts):
                flat, sizes = enc.encode(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], build(flat, sizes)], [*names, field])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], f"{field} {kind}"])
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`")).mapInArrow(run, schema)


def token_ids(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json", field: str = "ids") -> DataFrame:
    """``df`` with ``field``, the list of token ids, in place of ``text``. A column named ``field`` is replaced."""

    def build(flat: list[int], sizes: list[int]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return _map(df, text, path, field, "array<int>", build)


def token_counts(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json", field: str = "tokens") -> DataFrame:
    """``df`` with ``field``, the number of tokens, in place of ``text``."""
    return _map(df, text, path, field, "bigint", lambda flat, sizes: pa.array(sizes, pa.int64()))
