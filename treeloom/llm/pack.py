"""Packing by power-of-two decomposition.

A document's ids, closed by one end id, are cut into pieces whose lengths are the binary digits of its
length: as many whole sequences as fit, then ever smaller powers of two. Each piece is a sequence of
its own, so no sequence crosses documents and none holds padding; `bucket` is the logarithm of the
length, by which a trainer batches sequences of equal length.

Nothing is shuffled: a piece depends on its own document alone. Sequence ids are those of
monotonically_increasing_id over the input's partitions, so a lost partition gets the same ids again.

Defined cases: a null text is the empty text and gives one piece with the end id; a document of any
length is tokenized whole; repeated rows are packed as often as they occur; an empty table gives an
empty table.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.scratch import small_batches, worker_cache

#: Units whose ids a worker remembers at most; then it starts anew.
MEMO_WORDS = 250_000
#: Bytes of texts whose words are told apart together, unless one batch alone has more.
GROUP_BYTES = 4 << 20
#: Ids that one output batch holds at most, unless one document alone has more.
BATCH_IDS = 1_000_000
#: ASCII punctuation: behind letters it is one unit of its own.
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def plain_letters() -> str:
    """All letters that the tokenizer sees as nothing else: some become a letter and a mark as it composes and lowers them."""
    letters = filter(str.isalpha, map(chr, range(0x40000)))
    return "".join(c for c in letters if unicodedata.normalize("NFC", c).lower().isalpha())


class WordIds:
    """Ids of texts by a tokenizer that never joins across ASCII white space.

    The distinct words of many texts are found at once, column-wise. A word of letters with
    punctuation behind it is two units, and ASCII letters count in lower case, as the tokenizer
    parts and lowers them too; any other word is one unit. Each distinct unit is encoded once. Units
    of letters are encoded many at a time: each ends with exactly one id of a word's end."""

    TOGETHER = 64
    BLOCK = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = plain_letters()
        self.clear()

    def clear(self) -> None:
        self.units: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def store(self, ids: np.ndarray, sizes: np.ndarray, names: list[bytes]) -> None:
        n = len(self.units)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        if n + len(names) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(names)), np.int64)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(names)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.units.update(zip(names, range(n, n + len(names)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def learn(self, letters: list[bytes], single: list[bytes]) -> None:
        """Store the ids of new units: of plain letters, and others."""
        groups, others = [letters[i : i + self.TOGETHER] for i in range(0, len(letters), self.TOGETHER)], list(single)
        for i in range(0, len(groups), self.BLOCK):
            block = groups[i : i + self.BLOCK]
            ids, sizes = self.encode([b" ".join(g).decode() for g in block])
            ends, bounds = self.ends[ids], np.cumsum(sizes)
            found = np.diff(np.r_[0, np.r_[0, np.cumsum(ends)][bounds]])
            told = (found == [len(g) for g in block]) & ends[bounds - 1]
            ids, ends = ids[of := np.repeat(told, sizes)], ends[of]
            self.store(ids, np.diff(np.r_[0, np.flatnonzero(ends) + 1]), [u for g, sure in zip(block, told, strict=True) if sure for u in g])
            others += [u for g, sure in zip(block, told, strict=True) if not sure for u in g]
        for i in range(0, len(others), 4096):
            self.store(*self.encode([u.decode() for u in others[i : i + 4096]]), others[i : i + 4096])

    def places(self, units: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Where each of many units is stored. letters: whether each is of plain letters."""
        units = units.dictionary_encode()
        names, which = units.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()
        at = list(map(self.units.get, names))
        if new := [i for i, x in enumerate(at) if x is None]:
            plain = np.zeros(len(names), bool)
            plain[which[letters]] = True
            self.learn([names[i] for i in new if plain[i]], [names[i] for i in new if not plain[i]])
            for i in new:
                at[i] = self.units[names[i]]
        return np.array(at, np.int64)[which]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        rest = pc.utf8_ltrim(words, characters=self.letters)
        two = pc.and_(pc.equal(pc.binary_length(pc.ascii_ltrim(rest, characters=PUNCTUATION)), 0), pc.less(pc.binary_length(rest), pc.binary_length(words)))
        letters = two.to_numpy(zero_copy_only=False)
        core = pc.if_else(two, pc.ascii_lower(pc.ascii_rtrim(words, characters=PUNCTUATION)), words)
        tail = pc.if_else(two, rest, pa.scalar("", words.type))
        units = np.stack([self.places(core, letters), self.places(tail, np.zeros(len(words), bool))], 1)
        size = self.starts[units + 1] - self.starts[units]
        return self.spread(units.ravel()), size.sum(1)

    def spread(self, units: np.ndarray) -> np.ndarray:
        start, size = self.starts[units], self.starts[units + 1] - self.starts[units]
        return self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by the end id, and where each text's end."""
        if len(self.units) > MEMO_WORDS:
            self.clear()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, sizes = self.of_words(words.dictionary)
        data, offsets = np.r_[ids, end_id].astype("<u4"), 4 * np.cumsum(np.r_[0, sizes, 1])
        known = pa.Array.from_buffers(pa.large_binary(), len(sizes) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        last = np.cumsum(pc.list_value_length(split).to_numpy() + 1) - 1
        which = np.full(len(words) + len(texts), len(sizes), np.int32)
        inner = np.ones(len(which), bool)
        inner[last] = False
        which[inner] = words.indices.to_numpy()
        _, offsets, data = known.take(pa.array(which)).buffers()
        bounds = np.frombuffer(offsets, np.int64)[last + 1] // 4
        return np.frombuffer(data, "<u4")[: bounds[-1]], bounds

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        flat, bounds = self.closed(pa.array(texts, pa.string()), 0)
        return [x[:-1] for x in np.split(flat, bounds[:-1])]


def lengths(n: int, most: int) -> list[int]:
    """n as whole sequences of `most`, a power of two, and then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of batches in a row, no null among the texts; those of a batch stay together."""
    held, size = [], 0
    for b in itertools.chain(batches, [None]):
        if held and (b is None or size + b.nbytes > GROUP_BYTES):
            keys, texts = (pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
            held, size = [], 0
            yield keys, pc.fill_null(texts, pa.scalar("", texts.type))
        if b is not None and b.num_rows:
            held.append(b)
            size += b.nbytes


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, most: int = 4096, ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids (null unless asked for), ids_crc32, doc_tokens, bucket, sequence_id, offset."""
    if most & (most - 1) or most < 1:
        raise ValueError("the longest sequence must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, bucket int"

    def cut(batches):
        cache = worker_cache()
        if (words := cache.get(tokenizer)) is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            words = cache[tokenizer] = WordIds(tokenizer)
        for keys, texts in together(batches):
            flat, bounds = words.closed(texts, end_id)
            total, first = np.diff(np.r_[0, bounds]), 0
            while first < len(total):
                before = bounds[first] - total[first]
                last = max(first + 1, int(np.searchsorted(bounds, before + BATCH_IDS, "right")))
                cuts = [lengths(n, most) for n in total[first:last].tolist()]
                row, n = np.repeat(np.arange(first, last), [len(x) for x in cuts]), np.array([x for y in cuts for x in y], np.int64)
                held = flat[before : bounds[last - 1]]
                at = np.r_[0, np.cumsum(n)]
                octets = memoryview(held).cast("B")
                crc = [zlib.crc32(octets[a:b]) for a, b in itertools.pairwise((4 * at).tolist())]
                pieces = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(held.view(np.int32))) if ids else pa.nulls(len(n), pa.list_(pa.int32()))
                columns = [keys.take(pa.array(row)), pa.array(at[:-1] + before - (bounds - total)[row]), pa.array(n), pieces, pa.array(crc, pa.int64()), pa.array(total[row]), pa.array(np.log2(n).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids", "ids_crc32", "doc_tokens", "bucket"])
                first = last

    pieces = docs.select(key, text).mapInArrow(cut, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
