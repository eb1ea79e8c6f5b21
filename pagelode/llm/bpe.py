"""BPE encoding and decoding with a word-end vocabulary file.

Words new to a worker are encoded together: an index maps each mergeable pair to all its positions in
the concatenated words, active ranks are applied in ascending order, and only the lists of the pairs
beside a merge are updated. Texts are whole, and a word's ids are kept for the words after it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size

#: Words whose ids a worker keeps, half of them since it last let go of those that weren't met again.
KEPT_WORDS = 300_000
#: Rows whose decoded texts stand in memory at once.
DECODED_ROWS = 500
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20
_NONE = np.zeros(0, np.int32)


_COMMON = regex.compile(r"[\x00-\u036f\u2000-\u206f\u20a0-\u20ac]*+\Z").match
_CHARS = [chr(c) for r in ((0, 0x370), (0x2000, 0x2070), (0x20A0, 0x20AD)) for c in range(*r)]


def common_pattern(pattern: str) -> re.Pattern[str]:
    """The pattern with its Unicode classes written out for the characters that _COMMON takes and those
    that lower-casing makes of them, as the standard library's engine is twice as fast."""
    chars = sorted({c for x in _CHARS for c in x + x.lower()})
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        held = [ord(c) for c in chars if regex.match(name, c)]
        starts = [c for c in held if c - 1 not in held]
        ends = [c for c in held if c + 1 not in held]
        pattern = pattern.replace(name, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)))
    return re.compile(pattern)


def _plain(text: str) -> bool:
    """Whether only characters occur on which Python and the library agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_COMMON(text))
    return True


class WordBpe:
    """The vocabulary, the merges by rank, and the splitting rules of the file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        keys = np.array([a << 32 | b for a, b, _ in self.merge], dtype=np.int64)
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        #: False if a merge makes a symbol of which an earlier merge makes use.
        used: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.merge):
            used.setdefault(a, r), used.setdefault(b, r)
        self.ordered = all(used.get(made, r) >= r for r, (_, _, made) in enumerate(self.merge))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        (split, _), steps = spec["pre_tokenizer"]["pretokenizers"], spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or not split["invert"] or model["end_of_word_suffix"] != "</w>":
            raise ValueError("not a lower-casing word-end vocabulary")
        self.pieces = common_pattern(split["pattern"]["Regex"])
        self.raw, self.library = raw, None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.bytes_of = {c: b for b, c in chars.items()}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[chars[b] + "</w>"] for b in range(256)], dtype=np.int32)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = np.array([names.get(i) for i in range(max(names) + 1)], dtype=object)
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings stand as they are."""
        if "<|" in text and self.marks.search(text):
            return [w for part in self.marks.split(text) for w in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if not _plain(text):
                return self._split_rare(text)
            text = unicodedata.normalize("NFC", text)
        return self.pieces.findall(text.lower())

    def _split_rare(self, text: str) -> list[str]:
        """By the library's own rules, whose tables of rare characters differ from Python's."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in shown]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge takes it."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian uint32, by one pair index over all of them."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        held = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[held]
        symbols[ends - 1] = self.final[held[ends - 1]]
        after, before = np.arange(1, len(held) + 1, dtype=np.int32), np.arange(-1, len(held) - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends[:-1]] = before[0] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(places: np.ndarray, ranks: np.ndarray) -> None:
            """Adds places to the lists of their pairs' ranks."""
            good = ranks >= 0
            places, ranks = places[good], ranks[good]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for i, j in zip(cuts, cuts[1:]):
                r = int(ranks[i])
                if r not in index:
                    index[r] = []
                    heappush(active, r)
                index[r].append(places[i:j])

        joined = np.flatnonzero(after >= 0).astype(np.int32)
        enlist(joined, self.ranks_of(symbols[joined], symbols[joined + 1]))
        while active:
            r = heappop(active)
            lists = index.pop(r)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            if not self.ordered and len(places) > 1:  # one place at a time, lest a new pair of lower rank waits
                index[r], places = [places[1:]], places[:1]
                heappush(active, r)
            left, right, made = self.merge[r]
            nexts = after[places]
            good = (symbols[places] == left) & (nexts >= 0) & (symbols[nexts] == right)
            places, nexts = places[good], nexts[good]
            if left == right and len(places) > 1:  # of overlapping pairs the leftmost goes first
                taken, gone = [], -1
                for k, (p, n) in enumerate(zip(places.tolist(), nexts.tolist())):
                    if p != gone:
                        taken.append(k)
                        gone = n
                places, nexts = places[taken], nexts[taken]
            if not len(places):
                continue
            symbols[places], symbols[nexts] = made, -1
            beyond = after[nexts]
            after[places] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = places[inside]
            ahead = before[places]
            behind = ahead >= 0
            rights, lefts = places[inside], ahead[behind]
            enlist(np.concatenate([lefts, rights]), np.concatenate([self.ranks_of(symbols[lefts], np.full(len(lefts), made)), self.ranks_of(np.full(len(rights), made), symbols[beyond[inside]])]))
        kept = symbols >= 0
        stops = np.cumsum(kept)[ends - 1] * 4
        packed = symbols[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The store of ids, with all of these words in it."""
        if len(self.ids) + len(words) > KEPT_WORDS // 2:
            self.ids, self.old = {}, self.ids
        missing = [w for w in words if w not in self.ids]
        self.ids |= {w: self.old[w] for w in missing if w in self.old}
        if new := [w for w in missing if w not in self.old]:
            plain = [w for w in new if w not in self.special]
            self.ids |= zip(plain, self.encode_words(plain)) if plain else {}
            self.ids |= {w: self.special[w].to_bytes(4, "little") for w in new if w in self.special}
        return self.ids


@lru_cache(maxsize=2)
def load(raw: bytes) -> WordBpe:
    return WordBpe(raw)


def tokenizer_file(docs: DataFrame, path: str):
    """The file as a broadcast: a vocabulary, of a fixed size whatever the input."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _encoded(bpe: WordBpe, texts: pa.Array) -> pa.ListArray:
    """Ids of each text."""
    place: dict[str, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in bpe.split(t)], dtype=np.int32) if t else _NONE for t in texts.to_pylist()]
    ids = bpe.learn(set(place))
    table = [ids[w] for w in place]
    sizes = np.array([len(x) // 4 for x in table] or [0])
    starts, words = np.cumsum(sizes) - sizes, np.concatenate(rows)
    n = sizes[words]
    ends = np.cumsum(n)
    values = np.frombuffer(b"".join(table), dtype="<i4")[np.repeat(starts[words] - (ends - n), n) + np.arange(n.sum())]
    stops = np.r_[0, ends][np.cumsum([0, *map(len, rows)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(values))


def _decoded(bpe: WordBpe, lists: pa.ListArray) -> pa.Array:
    """The strings of each row's ids, joined by a space."""
    values, ends = np.asarray(pa.compute.fill_null(lists.values, -1)), np.asarray(lists.offsets)
    texts = []
    for row, there in enumerate(lists.is_valid().to_pylist()):
        own = values[ends[row] : ends[row + 1]] if there else values[:0]
        known = own[(own >= 0) & (own < len(bpe.names))]
        texts.append(" ".join([x for x in bpe.names[known] if x is not None]))
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) for every row of docs, in one pass without a shuffle; with `decoded`, also
    what decode() makes of the ids, in the same pass.

    Null and empty texts, and texts of white space alone, have no ids. Repeated rows and keys each
    give a row; an empty table gives an empty one; other columns are left out. Special strings in a
    text become their ids; no begin or end ids are added."""
    held = tokenizer_file(docs, path)
    out = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for batch in by_size(batches, text, TEXT_BYTES):
            lists = _encoded(bpe, batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists, *[_decoded(bpe, lists)] * decoded], out.names)

    return docs.select(key, text).mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the tokens' strings joined by a space, as a file without a
    decoder asks. Null ids give an empty text; ids outside the vocabulary have no string."""
    held = tokenizer_file(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(at, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(bpe, batch.column(ids))], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
