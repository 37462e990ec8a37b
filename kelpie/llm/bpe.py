"""BPE encoding and decoding by tree concatenation.

A long text is halved until its pieces are leaves. All leaves of a block of rows are encoded together, then neighbours are joined: a
window around the join is encoded anew and grows until it agrees with the left half at its beginning and with the right half
at its end. Between white space, where no token can reach across, whole words are compared; in a long part without spaces a token of the window
must agree with the left half and another with the right half (same place, same id). Neighbouring tokens of the joined
sequence are then neighbours in some encoding, which is what makes a BPE sequence the one the tokenizer itself gives.
Leaves are encoded word by word from a bounded table of words, whose letters are compared, not only their hashes.

Null and empty texts give no ids. Ids of a vocabulary with up to 2**32 entries are kept as little-endian
unsigned 32-bit integers. Rows that repeat give equal ids, and a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kelpie.llm.common import HEAD, LONG, blocks, column_bytes, eights, lean, placed_words

#: Texts longer than this are encoded as a tree; leaves are half as long at least.
LEAF = 2048
#: Words of each side in the first window around a join.
WORDS = 2
BLANKS = dict.fromkeys(range(9, 14), " ")
#: Entries of the table of encoded parts in a worker; it starts anew when full.
TABLE = 300_000
#: Slots of the table that whole columns use, and ids that its words may take; it starts anew beyond.
SLOTS, POOL = 1 << 20, 1 << 23
#: The word pattern of this family of tokenizers, and what it is for characters of which each is its own normal form.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are kept as little-endian 32-bit numbers"
_OPEN: dict[str, Encoder] = {}
_POOL: list[ThreadPoolExecutor] = []


class Encoder(dict):
    """Encodes text as the tokenizer in the file `path` does without adding special tokens. Maps a part to its ids."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = leaf
        self.joins = 0
        self.token = {}
        self.decoded: dict[bytes, bytes] = {}
        # parts may be encoded apart only where white space never enters a token
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.apart = all(ids(a + gap + b) == ids(a) + ids(b) for a, b in (("a", "b"), ("a1", ".b"), ("'", "s")) for gap in (" ", "\n", " \n "))
        self.words: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes = self._byte_letters() if self._known(json.loads(self.tokenizer.to_str())) else None

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether words of plain characters can go straight to the merge model."""
        n, p, m = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        split = (p.get("pretokenizers") or [{}])[0]
        return ([x["type"] for x in n.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in p.get("pretokenizers", [])] == ["Split", "ByteLevel"]
                and split["pattern"].get("Regex") == PATTERN and split["invert"] and m["type"] == "BPE" and not m["dropout"] and all(x["content"].startswith("<|") for x in spec["added_tokens"]) and spec["post_processor"] is None)

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100)}

    def _word(self, word: str) -> bytes:
        if len(self.words) >= TABLE:
            self.words.clear()
        if not word.isascii():
            word_bytes = word.translate(self.bytes)
        else:
            word_bytes = word  # printable ASCII stands for itself
        ids = self.words[word] = array("I", [t.id for t in self.tokenize(word_bytes)]).tobytes()
        return ids

    def __missing__(self, part: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        ids = self.ids_of(part)
        if len(part) < 64:
            self[part] = ids
        return ids

    def ids_of(self, part: str) -> bytes:
        """The ids of a part without spaces or line breaks."""
        if not part:
            return b""
        if not (self.bytes and len(part) < 64 and (part.isascii() and part.isprintable() and "<|" not in part or PLAIN.fullmatch(part))):
            return self._ids(part)
        low = part.lower()
        # most parts are one word, or one with a mark behind it
        if low.isalpha():
            return self.words.get(low) or self._word(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return (self.words.get(low[:-1]) or self._word(low[:-1])) + (self.words.get(low[-1]) or self._word(low[-1]))
        return b"".join([self.words.get(w) or self._word(w) for w in PLAIN_WORDS.findall(low)])

    def _ids(self, part: str) -> bytes:
        if not part:
            return b""
        if len(part) > self.leaf:
            return np.array(self.tree(part)[0], "<u4").tobytes()
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text."""
        if not text:
            return b""
        if not self.apart:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    # ------------------------------------------------------------ whole columns

    def _fresh(self) -> None:
        # slots hold a hash and the number of a word; words have a place and a size in the pool of ids, and their letters
        self.hashes, self.word, self.known = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 0
        self.at, self.size, self.head, self.spelt, self.letters = (np.zeros(SLOTS, t) for t in (np.int32, np.int32, np.uint64, np.int64, np.int32))
        self.pool, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.spelling, self.written = np.zeros(1 << 20, np.uint8), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes in the open table, -1 where there is none."""
        slot, out, todo = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.full(len(h), -1, np.int32), np.arange(len(h))
        there, same = self.hashes[slot], None
        while True:
            same = there == h[todo]
            out[todo[same]] = self.word[slot[todo[same]]]
            todo = todo[~same & (there != 0)]
            if not len(todo):
                return out
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            there = self.hashes[slot[todo]]

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Puts new word hashes (different ones), the words' letters and their ids into the table."""
        if self.bytes:
            kept, plain, slow = self.words, self._word, self.ids_of
            found = [(kept.get(low) or plain(low)) if (low := w.decode().lower()).isalpha() and w.isascii() and len(w) < 64 else slow(w.decode()) for w in words]
        else:
            found = [self.ids_of(w.decode()) for w in words]
        new, size = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
        text, length = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        while self.filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.written + len(text) + 8 > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        self.pool[self.filled : self.filled + len(new)] = new
        self.spelling[self.written : self.written + len(text)] = text
        n = slice(self.known, self.known + len(h))
        self.at[n], self.size[n], self.letters[n] = self.filled + np.cumsum(size) - size, size, length
        self.spelt[n] = self.written + np.cumsum(length) - length
        self.head[n] = eights(text)[np.cumsum(length) - length] & HEAD[np.minimum(length, 8)]
        slot, todo = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.hashes[slot[todo]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]  # of several that want a slot, one gets it
            self.hashes[slot[free]], self.word[slot[free]] = h[free], self.known + free
            todo = todo[self.hashes[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        self.filled += len(new)
        self.written += len(text)
        self.known += len(h)

    def _same_letters(self, word: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bool:
        """Whether the words of raw are those of the table, letter by letter (eight at once)."""
        eight = eights(raw)
        if not ((self.letters[word] == lengths) & (self.head[word] == eight[starts] & HEAD[np.minimum(lengths, 8)])).all():
            return False
        more, j = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
        mine = np.ndarray((len(self.spelling) - 7,), "<u8", self.spelling, strides=(1,))
        while len(more):
            keep = HEAD[np.minimum(lengths[more] - j, 8)]
            if not (mine[self.spelt[word[more]] + j] & keep == eight[starts[more] + j] & keep).all():
                return False
            j += 8
            more = more[lengths[more] > j]
        for i in np.flatnonzero(lengths > LONG).tolist():
            if not np.array_equal(self.spelling[self.spelt[word[i]] :][: lengths[i]], raw[starts[i] : starts[i] + lengths[i]]):
                return False
        return True

    def encode_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids up to each word, first word of each row, places and lengths of words). Words are cut at the ends of rows.

        Words are looked up by 64-bit hashes and compared letter by letter; each new one is encoded.
        """
        h, first, starts, lengths = placed_words(raw, offsets, lower=False)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), first, starts, lengths
        h = np.maximum(h, np.uint64(1))
        if not hasattr(self, "pool") or self.known + len(h) > SLOTS * 3 // 4 and self.known > SLOTS // 4 or self.filled > POOL or self.written > 4 * POOL:
            self._fresh()
        word, data = self._find(h), None
        if len(missing := np.flatnonzero(word < 0)):
            new, where = np.unique(h[missing], return_index=True)
            data, w = raw.tobytes(), missing[where]
            if self.known + len(new) <= SLOTS * 7 // 8:  # else a text with more different words than the table holds
                self._learn(new, [data[a:b] for a, b in zip(starts[w].tolist(), (starts[w] + lengths[w]).tolist(), strict=True)])
                word[missing] = self._find(h[missing])
        if (word < 0).any() or not self._same_letters(word, raw, starts, lengths):
            data = data or raw.tobytes()
            found = [self[data[a:b].decode()] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]
            return np.frombuffer(b"".join(found), "<u4"), np.r_[0, np.cumsum([len(x) // 4 for x in found])], first, starts, lengths
        size = self.size[word]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.at[word] - (ends - size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at], np.r_[0, ends], first, starts, lengths

    def encode_column(self, col: pa.Array, tree: bool = False) -> Iterator[np.ndarray]:
        """The ids of each row, unsigned 32-bit. With `tree`, texts of more than `leaf` bytes are encoded by halves that are joined."""
        if not self.apart:
            yield from (np.frombuffer(self.encode(t.as_py()), "<u4") for t in col)
            return
        raw, at = column_bytes(col)
        for lo, hi in blocks(at, 1 << 20):
            part, offsets = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            cuts, rows = self._halves(part, offsets) if tree else (offsets, np.arange(len(offsets)))
            ids, ends, first, starts, lengths = self.encode_words(part, cuts)
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                if b - a == 1:
                    yield ids[ends[first[a]] : ends[first[b]]]
                else:
                    yield self._joined(part, cuts, ids, ends, first, starts, lengths, a, b)

    # ------------------------------------------------------------ long texts: halves and their joins

    def _halves(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets with long rows halved until no piece is over `leaf` bytes, and where each row begins among them. Characters stay whole."""
        sizes = np.diff(offsets)
        pieces = 2 ** np.ceil(np.log2(np.maximum(sizes / self.leaf, 1))).astype(np.int64)
        rows = np.r_[0, np.cumsum(pieces)]
        row = np.repeat(np.arange(len(sizes)), pieces)
        cuts = offsets[row] + (np.arange(len(row)) - rows[row]) * sizes[row] // pieces[row]
        inner = np.flatnonzero(np.arange(len(row)) != rows[row])
        for _ in range(3):  # a character has at most three bytes behind its first
            cuts[inner] -= (raw[cuts[inner]] & 0xC0) == 0x80
        return np.r_[cuts, offsets[-1]], rows

    def _joined(self, raw, cuts, ids, ends, first, starts, lengths, a: int, b: int) -> np.ndarray:
        """The ids of a text whose leaves are the rows a to b of cuts.

        Around each cut a window of words, some of each side, is encoded anew and grows until its first word has the ids that the left
        side has for it and its last word those that the right side has. Words between white space are encoded apart from each other,
        so what agrees at both ends stays. Where leaves hold too few words for that (text without spaces), tokens are joined instead.
        """
        if int(np.diff(first[a : b + 1]).min()) < 4 * WORDS:
            return np.array(self.tree(raw[cuts[a] : cuts[b]].tobytes().decode())[0], np.uint32)
        data, out, since = raw, [], int(ends[first[a]])
        for cut in range(a + 1, b):
            w, k = int(first[cut]), WORDS
            while True:
                left, right = w - k, w + k - 1
                window = data[starts[left] : starts[right] + lengths[right]].tobytes().decode().translate(BLANKS).split(" ")
                found = [self[p] for p in window if p]
                agree = found[0] == ids[ends[left] : ends[left + 1]].tobytes() and found[-1] == ids[ends[right] : ends[right + 1]].tobytes()
                if agree or 2 * k > WORDS * 2:
                    break
                k *= 2
            if not agree:
                return np.array(self.tree(raw[cuts[a] : cuts[b]].tobytes().decode())[0], np.uint32)
            self.joins += 1
            out += [ids[since : ends[left]], np.frombuffer(b"".join(found), "<u4")]
            since = int(ends[right + 1])
        out.append(ids[since : ends[first[b]]])
        return np.concatenate(out)

    # ------------------------------------------------------------ tree concatenation

    def _leaf(self, text: str, at: int) -> tuple[list[int], list[tuple[int, int]]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [(a + at, b + at) for a, b in e.offsets]

    def tree(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and character spans of a long text, from leaves encoded in parallel and joined pairwise."""
        cuts = list(range(0, len(text), self.leaf))
        if not _POOL:
            _POOL.append(ThreadPoolExecutor(2))
        parts = [(at, end, *x) for (at, end), x in zip([(a, min(a + self.leaf, len(text))) for a in cuts], _POOL[0].map(lambda a: self._leaf(text[a : a + self.leaf], a), cuts), strict=True)]
        while len(parts) > 1:
            parts = [self._join(text, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][2], parts[0][3]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        (a, _, lids, lspans), (_, b, rids, rspans) = left, right
        k = 16
        while True:
            begin = lspans[-k][0] if k < len(lids) else a
            end = rspans[k - 1][1] if k < len(rids) else b
            if begin == a and end == b:
                self.joins += 1
                return (a, b, *self._leaf(text[a:b], a))
            wids, wspans = self._leaf(text[begin:end], begin)
            low = max(0, len(lids) - k)
            mine = {(s, i): n for n, (s, i) in enumerate(zip(lspans[low:], lids[low:], strict=True), low)}
            theirs = {(s, i): n for n, (s, i) in enumerate(zip(rspans[:k], rids[:k], strict=True))}
            # a token that another shares its characters with (one character as several tokens) settles nothing
            alone = [n for n, s in enumerate(wspans) if s[1] > s[0] and (n == 0 or wspans[n - 1][1] <= s[0]) and (n + 1 == len(wspans) or wspans[n + 1][0] >= s[1])]
            p = next((n for n in alone if (wspans[n], wids[n]) in mine), None) if begin > a else -1
            q = next((n for n in reversed(alone) if (wspans[n], wids[n]) in theirs), None) if end < b else len(wids)
            if p is not None and q is not None and p < q:
                self.joins += 1
                head, tail = (mine[wspans[p], wids[p]], p) if p >= 0 else (0, 0), (theirs[wspans[q], wids[q]], q) if q < len(wids) else (len(rids), q)
                return a, b, lids[: head[0]] + wids[head[1] : tail[1]] + rids[tail[0] :], lspans[: head[0]] + wspans[head[1] : tail[1]] + rspans[tail[0] :]
            k *= 2

    # ------------------------------------------------------------ decoding

    def decode(self, ids: bytes) -> str:
        """What the tokenizer's decode(ids, skip_special_tokens=False) gives."""
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8. Without a decoder, tokens stand side by side with a space between."""
        if self.tokenizer.decoder is not None:
            return self.decode(ids).encode()
        if not self.token:
            self.token = {i: s.encode() for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return b" ".join(map(self.token.__getitem__, filter(self.token.__contains__, np.frombuffer(ids, "<u4").tolist())))


def encoder(path: str) -> Encoder:
    """The worker's own encoder of the file at path."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with one more binary column: the ids of the whole text, little-endian unsigned 32-bit.

    A null text gives empty ids. Rows stay where they are (no shuffle); a column named `out` is replaced.
    """
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            ids = [x.astype("<u4").tobytes() for x in own.encode_column(b.column(b.schema.get_field_index(text)), tree=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(ids, pa.binary())], names=[*keep, out])

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField(out, T.BinaryType())])
    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with one more string column: the text of the ids, as the tokenizer decodes them; null ids give an empty text."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            back = [own.decode_bytes(i.as_py() or b"").decode() for i in b.column(b.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(back, pa.string())], names=[*keep, out])

    from pyspark.sql import types as T

    return df.mapInArrow(lean(run), T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField(out, T.StringType())]))


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens and the SHA-256 of the ids and of the decoded text. Encodes and decodes in one pass."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            n, one, two = [], [], []
            for x in own.encode_column(b.column(1), tree=True):
                ids = x.astype("<u4").tobytes()
                n.append(len(x))
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(lean(run), T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
