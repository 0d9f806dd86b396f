"""Byte-level BPE with a transducer lexicon.

One pass counts the pre-tokens of all texts; the most frequent ones (`LEXICON_WORDS`, a bound on
memory only: results do not depend on it) are merged once on the driver and compiled into a
minimal acyclic automaton whose states share suffixes.  Every transition carries the number of
words that sort before it, so a walk ends at the word's index among the sorted words, and that
index leads to its ids.  The automaton is one flat file, sent to every machine by the session and
mapped into memory there.  A pre-token that the automaton does not hold is merged exactly.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import commonest, written

LEXICON_WORDS = 1 << 18
#: pre-tokens that one Python worker remembers at once
REMEMBERED = 300_000

# Fixed value: the public byte-level pattern; white space is Unicode's White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: the same for texts of code points under 256, with their letters, numbers and white space listed: twice as fast
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.of_byte = [ids[c] for c in letters]
        self.rank = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[x], ids[y]] = (r, ids[x + y])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the lowest-ranked pair first, leftmost first."""
        ids, rank = [self.of_byte[b] for b in word], self.rank
        if len(ids) > 48:
            return self._merge_long(ids)
        none = (1 << 30, 0)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap over a linked list: a run of n bytes takes n log n steps."""
        rank, n = self.rank, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (ids[p], ids[q]) in rank:
                    heapq.heappush(heap, (*rank[ids[p], ids[q]], p, (ids[p], ids[q])))
        return tuple(x for x in ids if x >= 0)

    def pretokens(self, text: str) -> list[str]:
        """The pieces whose merges are independent; special tokens stand as they are."""
        try:
            text.encode("latin-1")
            find = NARROW.findall
        except UnicodeEncodeError:
            find = self.pattern.findall
        if self.split is None or not any(s in text for s in self.special):
            return find(text)
        return list(chain.from_iterable([p] if i % 2 else find(p) for i, p in enumerate(self.split.split(text))))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """One int64 array: four sizes, transition keys (state * 256 + byte), their targets, their word counts, final flags, id offsets, ids."""
    words = sorted(entries)
    nodes: list[tuple[dict[int, int], bool]] = []  # finished states, children by byte
    register: dict[tuple, int] = {}

    def finish(node) -> int:
        kids, final = node
        key = (final, *kids.items())
        if key not in register:
            register[key] = len(nodes)
            nodes.append((kids, final))
        return register[key]

    path, last = [[{}, False]], b""  # open states along the last word
    for w in [*words, None]:
        same = 0 if w is None else len(os.path.commonprefix([w, last]))
        while len(path) - 1 > same:
            done = finish(path.pop())
            path[-1][0][last[len(path) - 1]] = done
        if w is None:
            break
        path += [[{}, False] for _ in w[same:]]
        path[-1][1] = True
        last = w
    root = finish(path[0])
    below = []  # words from a state on; children come before their parents
    for kids, final in nodes:
        below.append(final + sum(below[k] for k in kids.values()))
    keys, targets, skips = [], [], []
    for s, (kids, final) in enumerate(nodes):
        before = int(final)
        for b in sorted(kids):
            keys.append(s << 8 | b)
            targets.append(kids[b])
            skips.append(before)
            before += below[kids[b]]
    ids = [entries[w] for w in words]
    return np.array([len(keys), len(nodes), len(words), root, *keys, *targets, *skips, *(f for _, f in nodes), 0, *np.cumsum([len(i) for i in ids]), *chain.from_iterable(ids)], np.int64)


class Lexicon:
    """A compiled lexicon, read where it lies."""

    def __init__(self, flat: np.ndarray):
        edges, states, words, self.root = (int(x) for x in flat[:4])
        at = np.cumsum([4, edges, edges, edges, states, words + 1])
        self.keys, self.targets, self.skips, self.final, self.offsets = (flat[a:b] for a, b in zip(at, at[1:]))
        self.ids = flat[at[-1] :]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's index among the lexicon's words, -1 where it holds none; all words walk side by side."""
        index = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return index - 1
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        state, going, step = np.full(len(words), self.root), np.arange(len(words)), 0
        while len(going):
            going = going[lengths[going] > step]
            key = state[going] << 8 | raw[begin[going] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[going[~hit]] = -1
            going, at = going[hit], at[hit]
            index[going] += self.skips[at]
            state[going] = self.targets[at]
            step += 1
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(known, index, -1)


class Table:
    """What a worker knows of words: for each its ids, all in one array."""

    def __init__(self, lexicon: Lexicon, vocab: Vocabulary):
        self.lexicon, self.vocab = lexicon, vocab
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        vocab, lexicon = self.vocab, self.lexicon
        raw = [w.encode() for w in words]
        at = lexicon.find(raw)
        known = np.flatnonzero(at >= 0)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[known], size[known] = lexicon.offsets[at[known]], lexicon.offsets[at[known] + 1] - lexicon.offsets[at[known]]
        flat = [lexicon.ids[ragged(begin[known], size[known])]]
        begin[known] = np.cumsum(size[known]) - size[known]
        done = len(flat[0])
        more: list[int] = []
        for i in np.flatnonzero(at < 0).tolist():
            ids = (vocab.special[words[i]],) if words[i] in vocab.special else vocab.merge(raw[i])
            begin[i], size[i] = done + len(more), len(ids)
            more += ids
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words))))
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat[0].astype(np.int32), np.array(more, np.int32)])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


def _count(path: str):
    def run(batches):
        vocab, seen = vocabulary(path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(vocab.pretokens(text.as_py() or ""))
                if len(seen) > REMEMBERED:
                    yield flush()
        if seen:
            yield flush()

    return run


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their counts, `most` at most."""
    counts = written(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pretokens")
    got = commonest(counts, most).toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))


def publish_lexicon(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of docs and sends it to every machine; returns the name it has there."""
    vocab = vocabulary(path)
    entries = {w.encode(): vocab.merge(w.encode()) for w in frequent_words(docs, path, text_col, most) if w not in vocab.special}
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    where = os.path.join(tempfile.mkdtemp(prefix="buildloom-"), name)
    np.save(where, compile_lexicon(entries))
    docs.sparkSession.sparkContext.addFile(where)
    return name


def _encode(path: str, name: str):
    def run(batches):
        vocab = vocabulary(path)
        table = Table(_mapped(name), vocab)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                texts = [vocab.pretokens(t or "") for t in column.slice(at, 256).to_pylist()]
                new = [w for w in set().union(*texts) if w not in table.place]
                if len(table.place) + len(new) > REMEMBERED:
                    table.clear()
                    new = list(set().union(*texts))
                if new:
                    table.learn(new)
                count = np.fromiter(map(len, texts), np.int64, len(texts))
                place = np.fromiter(map(table.place.__getitem__, chain.from_iterable(texts)), np.int64, int(count.sum()))
                size = table.size[place]
                total = np.concatenate([[0], np.cumsum(size)])
                ends = total[np.concatenate([[0], np.cumsum(count)])]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table.flat[ragged(table.begin[place], size)]))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns[1:]), ids], names=[*batch.schema.names[1:], "ids"])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """docs without the text column and with `ids` (array<int>): the text's BPE ids, special tokens recognised.

    A null text counts as empty and has no ids.  Other columns and repeated rows stay; a column
    named ids is replaced.  An empty table gives an empty one."""
    name = publish_lexicon(docs, path, text_col, most)
    others = [c for c in docs.columns if c not in (text_col, "ids")]
    frame = docs.select(F.col(text_col).cast("string"), *others)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:])
    return frame.mapInArrow(_encode(path, name), kinds + ", ids array<int>" if kinds else "ids array<int>")


def _decode(path: str):
    def run(batches):
        vocab = vocabulary(path)
        most = max(vocab.bytes) + 1
        size = np.array([len(vocab.bytes.get(i, b"")) for i in range(most)], np.int64)
        begin, letters = np.cumsum(size) - size, np.frombuffer(b"".join(vocab.bytes.get(i, b"") for i in range(most)), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            for at in range(0, batch.num_rows, 256):
                part = column.slice(at, 256).fill_null([])
                ids, count = part.flatten().to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy())
                raw = letters[ragged(begin[ids], size[ids])]
                ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(count)])]
                data = raw.tobytes()
                try:
                    data.decode()
                    whole = not np.any((raw[ends[:-1][ends[:-1] < len(raw)]] & 0xC0) == 0x80)
                except UnicodeDecodeError:
                    whole = False
                if whole:
                    texts = pa.StringArray.from_buffers(len(part), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
                else:
                    texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns), texts], names=[*batch.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with `decoded`: the text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD.

    Null ids decode to the empty text; a column named decoded is replaced."""
    frame = tokens.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(_decode(path), kinds + ", decoded string")


def digests(tokens: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside doc_id."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
