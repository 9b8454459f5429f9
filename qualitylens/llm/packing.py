"""Packing documents into token sequences by order-preserving dynamic programming.

A partition's documents form one stream of ids, each document closed by the
end id. Windows of at most ``seq_len`` ids are cut from the stream in order.
Cuts lie at the ends of documents or sentences, and within a sentence only
where it is long. A window costs its padding, none if its length is a power
of two of at least ``LEAST`` ids, plus a penalty if its end truncates a
document. Before the stream's end there is also a cut every ``LEAST`` ids, so
that the programme can close the stream with powers of two; a stream shorter
than a window may have to be padded. With f the least cost of the stream up to
a cut,

    f(j) = penalty(j) + min( min over i in reach of f(i) + pos(i)  + seq_len - pos(j),
                             min over powers of two of f(at pos(j) - power) )

and the inner minimum over a sliding reach comes from a monotone queue, so the
cost is linear in the cuts. The programme runs over blocks of the stream: all
but the last windows of a block are kept and the rest is carried over, so
memory is bounded by a block and one batch of documents.

There is no shuffle: partitions are packed where they are read. Sequences are
numbered by partition and then in order, so a task that is run again gives the
same rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylens.llm.common import arrow_batches

SEQ_LEN = 2048
END_ID = 1
#: Penalties in ids of padding, for cuts at a sentence's end and within one.
SENTENCE_PENALTY, INNER_PENALTY = 8, 64
#: Within a longer sentence, so many ids lie between possible cuts.
GRID = 128
#: The shortest window that is not padded.
LEAST = 32
BLOCK = 256 * SEQ_LEN
#: Words, and parts of words, whose ids a worker remembers; then it starts anew.
CACHE_WORDS = 500_000

#: Latin letters, then marks.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,!?;:|*%$#&]*)")


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary:
    printable ones for themselves, the others for those from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts on which ids put together from words must equal the tokenizer's own.
_PROBES = ["The words, of 3 lines.\nÉté (naïve) co-operates x_y  a\tb", " leading and UPPER, don't 1234... 日本語 😀\r\n", "ß%%% thouhe$$$ ÑandÜ\u00a0\u200bz"]


class WordIds:
    """Ids of words, each distinct word encoded once.

    The tokenizer drops white space and never joins what it separates, so a
    document's ids are its words' ids in order.
    """

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._made:
            made = cls(path)
            for text in _PROBES:
                if made.texts(pa.array([text]))[0].astype("<u4").tobytes() != made._encode(text):
                    raise ValueError(f"{path}: its ids depend on more than a word at a time, which packing does not support")
            cls._made[path] = made
        return cls._made[path]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Latin letters with marks after them are two pre-tokens whose cases
        fold: such parts recur more than the words do, and the letters go
        straight to the tokenizer's model. All else takes its whole way."""
        known, parts, tokenize = self.known, self.parts, self.tokenizer.model.tokenize
        for word in words:
            plain = _PLAIN.fullmatch(word)
            if not plain:
                known[word] = self._encode(word)
                continue
            letters, marks = plain[1].lower(), plain[2]
            ids = parts.get(letters)
            if ids is None:
                tokens = tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_CHARS))
                ids = parts[letters] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if marks:
                more = parts.get(marks)
                if more is None:
                    more = parts[marks] = self._encode(marks)
                ids += more
            known[word] = ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row without end ids, each text's number of
        ids, and the positions after sentence ends."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = split.offsets.to_numpy()
        coded = pc.dictionary_encode(split.flatten())
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        for cache in (self.known, self.parts):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        missing = [w for w in words if w not in self.known]
        if missing:
            self._learn(missing)
        raw = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(raw), dtype=np.uint32)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        closes = np.fromiter((w[-1:] in (".", "!", "?") for w in words), dtype=bool, count=len(words))
        first = np.cumsum(size) - size
        sizes = size[codes]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        after = np.concatenate([[0], ends])
        return ids, np.diff(after[bounds - bounds[0]]), ends[closes[codes]]


def padding(length: int, seq_len: int) -> int:
    return 0 if length & (length - 1) == 0 else seq_len - length


def cut_windows(pos: list[int], penalty: list[int], seq_len: int) -> list[int]:
    """Ends of the cheapest windows over cuts ``pos`` (increasing, from 0 to
    the stream's length, no gap above ``seq_len``)."""
    powers = [1 << k for k in range(seq_len.bit_length()) if LEAST <= 1 << k < seq_len]
    at = {p: i for i, p in enumerate(pos)}
    cost, back = [0] * len(pos), [0] * len(pos)
    queue = deque([(0, 0)])  # (cost + position, index), increasing in both
    push, pop, left, get = queue.append, queue.pop, queue.popleft, at.get
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - seq_len
        while pos[queue[0][1]] < low:
            left()
        best, i = queue[0]
        best += seq_len - p
        for power in powers:
            k = get(p - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, j))
    ends, j = [], len(pos) - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


class Packer:
    """The stream of one partition: what is not packed yet, and its documents."""

    def __init__(self, seq_len: int, sequence: int):
        self.seq_len, self.sequence = seq_len, sequence
        self.ids, self.inner = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        #: Of each document that is not wholly packed: id, ids packed before, ids in the stream, all ids.
        self.docs: list[list] = []

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray, sentence_ends: np.ndarray) -> None:
        """Documents with their end ids in place."""
        self.inner = np.concatenate([self.inner, sentence_ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [[name, 0, n, n] for name, n in zip(names, sizes.tolist(), strict=True)]

    def cuts(self, last: bool) -> tuple[list[int], list[int]]:
        total = len(self.ids)
        doc_ends = np.cumsum([d[2] for d in self.docs])
        pos = np.unique(np.concatenate([[0], self.inner, doc_ends]))
        gaps = np.diff(pos)
        long = np.flatnonzero(gaps > GRID)
        if len(long):
            n = (gaps[long] - 1) // GRID
            more = np.repeat(pos[long], n) + GRID * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
            pos = np.unique(np.concatenate([pos, more]))
        if last:
            pos = np.union1d(pos, np.arange(total, max(0, total - 2 * self.seq_len), -LEAST))
        penalty = np.full(len(pos), INNER_PENALTY)
        penalty[np.isin(pos, self.inner)] = SENTENCE_PENALTY
        penalty[np.isin(pos, doc_ends)] = 0
        assert pos[-1] == total
        return pos.tolist(), penalty.tolist()

    def take(self, last: bool) -> pa.RecordBatch | None:
        """Pack what is there; unless ``last``, keep back the final windows."""
        if not len(self.ids):
            return None
        ends = cut_windows(*self.cuts(last), self.seq_len)
        if not last:
            ends = [e for e in ends if e <= len(self.ids) - 4 * self.seq_len]
        if not ends:
            return None
        done = ends[-1]
        sizes = np.array([d[2] for d in self.docs])
        doc_ends = np.cumsum(sizes)
        stops = np.unique(np.concatenate([ends, doc_ends[doc_ends <= done]]))
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(ends, starts, side="right")
        window_starts = np.concatenate([[0], ends[:-1]])
        packed = np.array([d[1] for d in self.docs])
        names = [self.docs[k][0] for k in doc]
        raw = self.ids[:done].astype("<u4").tobytes()
        out = pa.record_batch(
            {
                "doc_id": pa.array(names, pa.int64()),
                "start": pa.array(starts - (doc_ends - sizes)[doc] + packed[doc], pa.int64()),
                "length": pa.array(stops - starts, pa.int64()),
                "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                "doc_tokens": pa.array([self.docs[k][3] for k in doc], pa.int64()),
                "sequence_id": pa.array(window + self.sequence, pa.int64()),
                "offset": pa.array(starts - window_starts[window], pa.int64()),
            }
        )
        self.sequence += len(ends)
        k = int(np.searchsorted(doc_ends, done, side="right"))
        self.docs = self.docs[k:]
        if self.docs:
            gone = done - int(doc_ends[k] - sizes[k])
            self.docs[0][1] += gone
            self.docs[0][2] -= gone
        self.ids, self.inner = self.ids[done:], self.inner[self.inner > done] - done
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Pack the documents' ids into sequences of at most ``seq_len``.

    ``docs``: doc_id, text; other columns are ignored. Returns a row per piece:
    doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32 bit), doc_tokens (with the end id), sequence_id, offset (in the
    sequence). Null and empty texts are the end id alone; a null doc_id stays
    null; rows that repeat are packed each; an empty table gives no rows. A
    document of any length is cut over as many windows as it needs. No window
    of fewer than ``LEAST`` ids is cut off to save padding; only a stream's
    last may be that short.
    """
    path = tokenizer or default_tokenizer()
    arrow_batches(docs.sparkSession)

    def run(batches):
        words = WordIds.of(path)
        packer = Packer(seq_len, TaskContext.get().partitionId() << 33)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            nbytes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            parts = np.unique(np.append(np.searchsorted(nbytes, np.arange(1, (nbytes[-1] if len(nbytes) else 0) // 2_000_000 + 1) * 2_000_000), len(names)))
            a = 0
            for b in parts.tolist():  # some 2 MB of text at a time
                if b == a:
                    continue
                ids, sizes, sentences = words.texts(texts.slice(a, b - a))
                doc_ends = np.cumsum(sizes)
                # the end ids move every later position on by the documents before it
                sentences = sentences + np.searchsorted(doc_ends, sentences, side="left")
                packer.add(names[a:b], np.insert(ids, doc_ends, end_id), sizes + 1, sentences)
                a = b
                if len(packer.ids) >= BLOCK and (out := packer.take(False)):
                    yield out
        if out := packer.take(True):
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replace the ids by their checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc_of(ids) -> int:
    """The same checksum of a list of ids."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
