"""Token-id files: shards of ids compressed by a Re-Pair grammar.

Documents are dealt by ranges of doc_id and written in ascending order. A shard
holds whole documents, about ``shard_tokens`` ids. Its grammar is built by
Re-Pair in rounds: the pairs that occur at least a quarter as often as the most
frequent one are each given a nonterminal and replaced everywhere, left to
right; then a quarter of that, down to ``least`` times, until none is left.
Neither rounds nor pairs are capped; ``least`` is where a rule (12 bytes) costs
less than it saves (4 bytes a use). The file keeps the rules, the expansion
length of every rule, the remaining sequence, and the ids of its documents with
their token counts, so any token range is decoded by expanding only the symbols
that overlap it; ``read`` and ``fetch`` decode ranges and never a whole shard.

File format: Parquet rows ``part, shard, offset, n_tokens, vocabulary, rules,
lengths, sequence, doc_ids, doc_tokens``. part and shard order the rows;
offset is the shard's first token counted from the part's; rules are pairs of
little-endian unsigned 32-bit symbols, rule k being symbol vocabulary + k;
lengths and sequence are unsigned 32-bit too. The tokens before a part are the
sum over the parts before it: one number a part, never one a document.

Nulls and edges: a null or empty text has only the end id; rows with a null
doc_id come first; rows that repeat a doc_id are all written, ordered by text;
one text longer than a shard is a shard of its own; an empty table gives no
shards and no rows; columns other than doc_id and text are not read, so their
names can't clash.
"""

from __future__ import annotations

import json
import math
import os
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.session import map_arrow
from lodestone.sources.scratch import scratch_path

SCHEMA = "part int, shard int, offset long, n_tokens long, vocabulary int, rules binary, lengths binary, sequence binary, doc_ids array<long>, doc_tokens array<long>"
#: White space on which Python and the tokenizer might differ.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u200c\u200d\u2060\ufeff"
#: Marks that part from letters before them as one run; an apostrophe may not.
MARKS = string.punctuation.replace("'", "")
WORD_END = "</w>"
CACHE = 800_000
PART_BYTES = 256 << 20
#: A count that few of 2 ** 16 hash slots reach by chance with the pairs of a shard.
CROWD = 128
NORMAL = unicodedata.is_normalized
#: The set-up for which a text may be cut at white space and letters told from marks. Fixed values.
CUT_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Ids of whole texts.

    Where the tokenizer's file has the set-up ``CUT_AT_SPACE`` and no dropout,
    words are encoded once and kept, as it drops white space, joins nothing
    across it and lowers case. Texts where lowering first could matter (not in
    normal form C, or with a capital sigma) or that may hold an added token are
    encoded whole, and with any other set-up all texts are.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()
        parts = json.loads(spec)
        self.by_words = (
            all(parts[k] == v for k, v in CUT_AT_SPACE.items())
            and parts["model"].get("end_of_word_suffix") == WORD_END
            and not parts["model"].get("dropout")
            and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        )
        if self.by_words:  # the same model for letters alone, which need no normalising and part at spaces only
            parts["normalizer"], parts["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
            self.letters = Tokenizer.from_str(json.dumps(parts))

    def _forget(self) -> None:
        """Drops all kept words: their numbers, and their ids, which stand one word's behind another's."""
        self.words: dict[str, int] = {}
        self.ids, self.bounds = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, cores: list[str], run: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only and where each word's end, encoded in runs and told apart by the last token of each."""
        runs = [" ".join(cores[i : i + run]) for i in range(0, len(cores), run)]
        raw = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.ends[raw]) + 1
        return (raw, ends) if len(ends) == len(cores) else self._whole(cores)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self._direct(words)
        return np.frombuffer(b"".join(coded), np.uint32), np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of words by number."""
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        for some, how in ((letters, self._spelled), (others, self._whole)):
            if some:
                ids, ends = how(some)
                self.words.update(zip(some, range(len(self.words), len(self.words) + len(some)), strict=True))
                self.bounds.append(self.bounds[-1][-1] + ends)
                self.ids.append(ids)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Where each word's ids are kept; what is not known is learnt."""
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(numbers < 0)
        if len(at):
            new = [words[i] for i in at.tolist()]
            self._learn(new)
            numbers[at] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        return numbers

    def _lowered(self, text: str) -> str | None:
        """A text whose words are encoded by themselves, in lower case; None if it must be encoded whole."""
        if not self.by_words or "<|" in text or any(c in text for c in ODD_SPACE):
            return None
        if text.isascii():
            return text.lower()
        if "\u03a3" not in text and NORMAL("NFC", text) and NORMAL("NFC", low := text.lower()):
            return low
        return None

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of lowered texts: Arrow cuts them and numbers their distinct words, which are looked up once; ids are then gathered by number.

        A word of letters with marks behind it is the word and its marks, as the tokenizer parts letters from marks.
        """
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = cut.flatten().dictionary_encode()
        words = numbered.dictionary
        if len(self.words) + len(words) > CACHE:
            self._forget()
        bare = pc.ascii_rtrim(words, MARKS)
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(bare)).to_numpy()
        cores = bare.dictionary_encode()
        core, spelled = cores.indices.to_numpy(), _strings(cores.dictionary)
        alpha = np.fromiter(map(str.isalpha, spelled), bool, len(spelled))
        apart = np.flatnonzero(alpha[core] & (marks > 0))
        whole = np.flatnonzero(~alpha[core])
        # Two pieces a word: its letters, or all of it, and its marks, or nothing. "" also stands before and behind white space at a text's ends.
        pieces = np.full((len(words), 2), self._numbers([""])[0])
        at = np.zeros(len(spelled), np.int64)
        at[alpha] = self._numbers([w for w, a in zip(spelled, alpha.tolist(), strict=True) if a])
        pieces[:, 0] = at[core]
        pieces[whole, 0] = self._numbers(_strings(words.take(pa.array(whole))))
        tails = _tails(words, apart, marks[apart]).dictionary_encode()
        pieces[apart, 1] = self._numbers(_strings(tails.dictionary))[tails.indices.to_numpy()]
        self.ids, self.bounds = [np.concatenate(self.ids)], [np.concatenate(self.bounds)]
        ids, sizes = _gathered(self.ids[0], self.bounds[0], pieces.ravel())
        ids, sizes = _gathered(ids, np.r_[0, np.cumsum(sizes.reshape(-1, 2).sum(1))], numbered.indices.to_numpy())
        flat = ids.tobytes()
        bounds = (4 * np.r_[0, np.cumsum(sizes)][cut.offsets.to_numpy()]).tolist()
        return [flat[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        low = [self._lowered(t) for t in texts]
        parts = iter(self._by_words([t for t in low if t is not None]))
        whole = iter(self._direct([t for t, s in zip(texts, low, strict=True) if s is None]))
        return [next(whole) if s is None else next(parts) for s in low]


def _gathered(values: np.ndarray, bounds: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` between ``bounds`` that ``number`` names, one behind another, and their sizes."""
    sizes = np.diff(bounds)[number]
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[number] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return values[at], sizes


def _strings(words: pa.LargeStringArray) -> list[str]:
    """As ``to_pylist``, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _tails(words: pa.LargeStringArray, number: np.ndarray, sizes: np.ndarray) -> pa.LargeStringArray:
    """The last ``sizes`` bytes of the words that ``number`` names, cut out of the array's own buffer."""
    _, offsets, data = words.buffers()
    stops = np.frombuffer(offsets, np.int64)[words.offset + 1 :][number]
    ends = np.cumsum(sizes)
    at = np.repeat(stops - ends, sizes)
    at += np.arange(len(at))
    return pa.LargeStringArray.from_buffers(len(number), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.frombuffer(data or b"", np.uint8)[at]))


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """One a Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(spec)


def _occurrences(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur ``limit`` times, and place and rank of each of their occurrences, in order of place."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    count = np.diff(np.r_[first, len(ordered)])
    often = count >= limit
    rank = np.full(len(keys), -1, np.int32)
    rank[order[np.repeat(often, count)]] = np.repeat(np.arange(often.sum(), dtype=np.int32), count[often])
    at = np.flatnonzero(rank >= 0)
    return ordered[first[often]], at, rank[at]


def _slots(sequence: np.ndarray, bits: int) -> np.ndarray:
    """A hash slot below 2 ** ``bits`` of every pair of neighbours."""
    mixed = (sequence[:-1] * np.uint32(0x9E3779B1) + sequence[1:]) * np.uint32(0x85EBCA77)
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)).astype(np.intp)


def compress(ids: np.ndarray, vocabulary: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (k, 2), expansion lengths (k) and the sequence left, all unsigned 32-bit.

    Ends when no pair can be replaced ``least - 1`` times. A round sorts only
    pairs that can be frequent: by their hash slot's load, and once a round has
    gone down to ``least``, those that were frequent then or hold a new symbol.
    """
    sequence = np.asarray(ids, np.uint32)
    rules: list[np.ndarray] = []
    sizes, made, limit, places = np.ones(vocabulary, np.uint32), 0, None, None
    while len(sequence) >= 2:
        if places is None:
            bits = 20 if limit is None or limit < CROWD else 16  # so few slots stay in the processor's cache
            slot = _slots(sequence, bits)
            load = np.bincount(slot, minlength=1 << bits)
            limit = max(least, int(load.max()) // 4) if limit is None else limit
            places = np.flatnonzero((load >= limit)[slot])
        chosen, at, rank = _occurrences(sequence[places].astype(np.uint64) << np.uint64(32) | sequence[places + 1], limit)
        found = at = places[at]
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1][: len(at)])
        take = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0  # neighbours overlap: every other one
        at, rank = at[take], rank[take]
        keep = np.bincount(rank, minlength=len(chosen)) >= least - 1
        places = None
        if keep.any():
            symbol = vocabulary + made + np.cumsum(keep) - 1
            at, rank = at[keep[rank]], rank[keep[rank]]
            pair = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)[keep]
            rules.append(pair)
            sizes = np.r_[sizes, sizes[pair[:, 0]] + sizes[pair[:, 1]]]
            made += len(pair)
            stays = np.ones(len(sequence), bool)
            stays[at + 1] = False
            sequence = sequence.copy() if len(rules) == 1 else sequence  # the caller's, then an own one
            sequence[at] = symbol[rank]
            sequence = sequence[stays]
            if limit == least:
                moved = np.cumsum(stays, dtype=np.int32)
                moved -= 1
                new = moved[at]
                near = np.zeros(len(sequence) + 1, bool)  # one more, for the place before the first
                near[moved[found[stays[found]]]] = near[new] = near[new - 1] = True
                places = np.flatnonzero(near[: len(sequence) - 1])
        elif limit == least:
            break
        limit = max(least, limit // 4)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), sizes[vocabulary:], sequence


def expand(sequence: np.ndarray, rules: np.ndarray, vocabulary: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that a sequence of symbols stands for. lengths: of the rules, as ``compress`` gives them; else counted here.

    Every symbol is put at its own place, so a step handles only what is not an id yet.
    """
    if lengths is None:
        sizes = [1] * vocabulary
        for left, right in rules.tolist():
            sizes.append(sizes[left] + sizes[right])
        lengths = np.array(sizes[vocabulary:], np.int64)
    size = np.ones(len(sequence), np.int64)
    inner = sequence >= vocabulary
    size[inner] = lengths[sequence[inner] - vocabulary]
    ends = np.cumsum(size)
    at = ends - size
    out = np.empty(len(ends) and int(ends[-1]), np.uint32)
    while len(sequence):
        inner = sequence >= vocabulary
        out[at[~inner]] = sequence[~inner]
        at, pair = at[inner], rules[sequence[inner] - vocabulary]
        left = pair[:, 0]
        behind = np.ones(len(at), np.int64)
        deeper = left >= vocabulary
        behind[deeper] = lengths[left[deeper] - vocabulary]
        sequence, at = np.concatenate([left, pair[:, 1]]), np.concatenate([at, at + behind])
    return out


class Ranges:
    """Random access to the tokens of one shard.

    ahead: expand every rule once, for many ranges. A round's rules stand for
    runs that lie apart, each found three times at least, so that this is at
    most a third of the shard's ids a round.
    """

    def __init__(self, row: dict, ahead: bool = False):
        self.vocabulary = row["vocabulary"]
        self.rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        self.sequence = np.frombuffer(row["sequence"], np.uint32)
        self.lengths = np.frombuffer(row["lengths"], np.uint32)
        size = np.ones(len(self.sequence), np.int64)
        inner = self.sequence >= self.vocabulary
        size[inner] = self.lengths[self.sequence[inner] - self.vocabulary]
        self.ends = np.cumsum(size)
        self.spelt = self._spelt() if ahead else None

    def _spelt(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every symbol, one's behind another's, and their bounds."""
        rules = expand(np.arange(len(self.rules), dtype=np.uint32) + np.uint32(self.vocabulary), self.rules, self.vocabulary, self.lengths)
        ends = self.vocabulary + np.cumsum(self.lengths, dtype=np.int64)
        return np.r_[np.arange(self.vocabulary, dtype=np.uint32), rules], np.r_[np.arange(self.vocabulary + 1), ends]

    def __call__(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop; only the symbols that overlap the range are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        skip = start - (int(self.ends[a - 1]) if a else 0)
        own = self.sequence[a:b]
        ids = _gathered(*self.spelt, own)[0] if self.spelt else expand(own, self.rules, self.vocabulary, self.lengths)
        return ids[skip : skip + stop - start]


def encoded(batches: Iterator[pa.RecordBatch], own: Encoder, chars: int = 1 << 23) -> Iterator[tuple]:
    """doc_id and ids of every row, encoded by runs of rows of about so many characters."""
    docs: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1), strict=True):
            docs.append(doc.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield from zip(docs, own.encode(texts), strict=True)
                docs, texts, size = [], [], 0
    if docs:
        yield from zip(docs, own.encode(texts), strict=True)


def _shards(spec: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        vocabulary = max(own.tokenizer.get_vocab_size(), end_id + 1)
        end = np.uint32(end_id).tobytes()
        part, shard, offset = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, offset
            rules, lengths, sequence = compress(np.frombuffer(b"".join(ids), np.uint32), vocabulary)
            row = [part, shard, offset, sum(sizes), vocabulary, rules.tobytes(), lengths.tobytes(), sequence.tobytes(), list(docs), list(sizes)]
            shard, offset = shard + 1, offset + sum(sizes)
            ids.clear(), docs.clear(), sizes.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        held = 0
        for doc, coded in encoded(batches, own):
            ids.append(coded + end)
            docs.append(doc)
            sizes.append(len(coded) // 4 + 1)
            held += sizes[-1]
            if held >= shard_tokens:
                yield flush()
                held = 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = 1 << 20, parts: int | None = None) -> None:
    """Encode every text, append ``end_id`` to each, and write the shards below ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # read where the job is planned and sent with it
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, _shards(spec, end_id, shard_tokens), SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(row: dict, group_tokens: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """Index and ids of each document of a shard, decoded by ranges of about ``group_tokens``."""
    at, stops = Ranges(row, ahead=True), np.cumsum(row["doc_tokens"]).tolist()
    low = i = 0
    while i < len(stops):
        k = i + 1
        while k < len(stops) and stops[k] - low <= group_tokens:
            k += 1
        ids, begin = at(low, stops[k - 1]), low
        for doc in range(i, k):
            yield doc, ids[begin - low : stops[doc] - low]
            begin = stops[doc]
        i, low = k, stops[k - 1]


def read(spark: SparkSession, path: str, each: Callable[[np.ndarray], tuple] | None = None, columns: str = "ids array<int>") -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before it) and ``n_tokens`` of every document in the files, and its ids.

    each: what to give in place of the ids, with the schema in ``columns``.
    """
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a part
    bases, so_far = [], 0
    for row in totals:
        bases.append((row["part"], so_far))
        so_far += row["n"]
    base = spark.createDataFrame(bases, "part int, base long")
    names = [c.split()[0] for c in columns.split(", ")]
    given = each or (lambda ids: (ids.astype(np.int32),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                starts = np.cumsum(row["doc_tokens"]) - row["doc_tokens"] + row["base"] + row["offset"]
                out = [given(ids) for _, ids in _documents(row)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["doc_tokens"], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "start", "n_tokens", *names])

    joined = shards.join(F.broadcast(base), "part").drop("part", "shard", "n_tokens")  # a row a part: bounded by write()
    return map_arrow(joined, run, f"doc_id long, start long, n_tokens long, {columns}")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of the given documents: only their ranges are decoded, in shards that hold one of them."""
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                at, stops = Ranges(row), np.cumsum(row["doc_tokens"])
                found = [(d, at(int(z) - n, int(z)).astype(np.int32)) for d, n, z in zip(row["doc_ids"], row["doc_tokens"], stops, strict=True) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    shards = spark.read.schema(SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", F.lit(list(doc_ids)).cast("array<bigint>")))
    return map_arrow(shards, run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer_path: str, **kwargs) -> DataFrame:
    """Write the files, read them back, and give counts and the CRC of every document's ids."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, **kwargs)
    return read(docs.sparkSession, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")
