"""Token ids of many texts by the tokenizers and sentencepiece libraries, and operator 7: token counts.

A step's texts are one byte buffer. It is cut, with array arithmetic, where the tokenizer's own
pre-tokenizer always parts text; the pieces are dictionary-encoded in Arrow, each distinct piece is
looked up or given to the library once, and ids are gathered by numpy. Where a tokenizer file's
normaliser or pre-tokenizer is not one of those whose cuts are known, whole texts go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import steps

#: Pieces, and ids of pieces, that one Python worker remembers; it forgets all of them beyond.
MEMO_PIECES, MEMO_IDS = 300_000, 4_000_000
#: Characters of a piece that is remembered; pieces given to the library at a time.
PIECE_CHARS, ASK = 64, 4096
#: Bytes of a buffer that are cut at a time.
WINDOW = 4 << 20
#: Bytes of text in one step.
STEP_BYTES = 4 << 20

# White space of ASCII; other characters that some library reads as white space.
BLANK = b"\t\n\x0b\x0c\r "
BLANK_TOO = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
#: Punctuation that no token joins to a letter before it.
MARKS = b".,!?;:"
#: Latin letters that are one letter before and after Unicode composition and case folding.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: How the word tokenizer and the byte-level tokenizer part text, as their files say it.
WORDS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS_PRE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORDS_SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BYTES_PRE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

_blank, _letter, _mark = (np.zeros(256, bool) for _ in range(3))
_blank[list(BLANK)] = True
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_mark[list(MARKS)] = True
_before = _blank.copy()
_before[0x1C:0x20] = True
#: The last bytes of the longer blanks, as one number.
_LONG_BLANKS = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in BLANK_TOO if c >= 0x80), np.int64)
_loaded: dict[tuple[str, bool], object] = {}


def byte_letters() -> dict[int, int]:
    """The visible character that byte-level vocabularies write for each byte (a fixed rule)."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


def cuts(b: np.ndarray) -> np.ndarray:
    """Before which of these UTF-8 bytes a token never reaches across.

    Before ASCII white space that follows another character (a run of white space stays with what
    follows it), and between a letter and plain punctuation, for letters that no normaliser changes
    into a letter and a mark: ASCII and U+00C0 to U+00FF.
    """
    found = np.zeros(len(b), bool)
    found[1:] = _blank[b[1:]] & ~_before[b[:-1]]
    at = np.flatnonzero(found)
    long = at[b[at - 1] >= 0x80]
    if len(long):
        c, d, e = (np.where(long >= k, b[long - k], 0).astype(np.int64) for k in (1, 2, 3))
        found[long[np.isin(d << 8 | c, _LONG_BLANKS) | np.isin(e << 16 | d << 8 | c, _LONG_BLANKS)]] = False
    after = np.flatnonzero(_mark[b[1:]]) + 1
    last, lead = b[after - 1], np.where(after >= 2, b[after - 2], 0)
    found[after[_letter[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True
    return found


class Encoder:
    """Ids, or only their numbers, of whole texts by a .json file of the tokenizers library."""

    def __init__(self, path: str, with_ids: bool = True, most: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.with_ids, self.most = Tokenizer.from_file(path), with_ids, most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        self.words = file["normalizer"] == WORDS_NORMALIZER and file["pre_tokenizer"] == WORDS_PRE
        self.cuttable = (self.words or file["normalizer"] is None and file["pre_tokenizer"] == BYTES_PRE) and not file["post_processor"]
        for t in file["added_tokens"]:  # a special string must lie within one piece
            own = np.frombuffer(t["content"].encode(), np.uint8)
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or _blank[own].any() or cuts(own).any():
                self.cuttable = False
        plain = file["model"]["type"] == "BPE" and not (file["model"]["dropout"] or file["model"]["continuing_subword_prefix"])
        # a word of plain letters is one pre-token: the model may read it without the steps before it
        blank = f"[{BLANK.decode()}]*" if self.words else " ?"
        self.plain = re.compile(f"({blank})([{LATIN}]+)") if plain else None
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.size, self.begin, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0

    def written(self, piece: str) -> str | None:
        """The piece as the model reads it, if it is a plain word."""
        m = self.plain.fullmatch(piece) if self.plain else None
        if m is None:
            return None
        word = m[2].lower() if self.words else m[2]
        if not word.isascii():
            if not is_normalized("NFC", word):
                return None
            word = word.encode().decode("latin-1").translate(self.letters)
        return word if self.words or not m[1] else chr(self.letters[0x20]) + word

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Slots of new pieces, whose ids are kept until the encoder forgets."""
        sizes, ids, odd = np.zeros(len(pieces), np.int64), [], []
        own: list[int] = []
        order: list[int] = []
        for i, p in enumerate(pieces):
            sent = self.written(p)
            if sent is None:
                odd.append(i)
                continue
            got = [t.id for t in self.model.tokenize(sent)]
            sizes[i] = len(got)
            own += got
            order.append(i)
        ids.append(np.array(own, np.uint32))
        for a in range(0, len(odd), ASK):
            some = odd[a : a + ASK]
            e = self.tokenizer.encode([pieces[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            of = np.array(e.word_ids, np.int64) if len(e.ids) else np.zeros(0, np.int64)
            sizes[some] = np.bincount(of, minlength=len(some))
        order += odd
        slots = np.arange(len(pieces)) + len(self.size)
        begin = np.zeros(len(pieces), np.int64)
        placed = sizes[order]
        begin[order] = self.held + np.cumsum(placed) - placed
        self.size, self.begin = np.concatenate([self.size, sizes]), np.concatenate([self.begin, begin])
        self.held += int(sizes.sum())
        if self.with_ids:
            self.ids = np.concatenate([self.ids, *ids])
        for p, s in zip(pieces, slots.tolist(), strict=True):
            if len(p) <= PIECE_CHARS:
                self.memo[p] = s
        return slots

    def pieces(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens of the pieces between ``bounds``, and their ids one after the other."""
        if len(self.memo) > self.most or self.held > MEMO_IDS:
            self.forget()
        cut_up = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(b)])
        coded = cut_up.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = list(map(self.memo.get, distinct))
        new = [i for i, s in enumerate(slots) if s is None]
        if new:
            for i, s in zip(new, self.learn([distinct[i] for i in new]).tolist(), strict=True):
                slots[i] = s
        slot = np.array(slots, np.int64)[coded.indices.to_numpy()]
        size = self.size[slot]
        if not self.with_ids:
            return size, self.ids[:0]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.begin[slot] - first, size)
        return size, self.ids[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens per text, ids of all texts one after the other); null is empty."""
        if not self.cuttable:
            return self.whole(texts)
        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        b = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts, sizes, ids = [], [], []
        low, window = 0, WINDOW
        while low < len(b):
            high = min(low + window, len(b))
            own = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "right")]
            head = min(low, 3)  # the character before the window
            inner = cuts(b[low - head : high])[head:]
            inner[own[own < high] - low] = True
            inner[0] = False
            inner = np.flatnonzero(inner) + low
            if high < len(b) and not len(inner):  # one long piece
                window *= 2
                continue
            high = len(b) if high == len(b) else int(inner[-1])
            bounds = np.concatenate([[low], inner[inner < high], [high]])
            size, found = self.pieces(b, bounds)
            starts.append(bounds[:-1])
            sizes.append(size)
            ids.append(found)
            low, window = high, WINDOW
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        at = total[np.searchsorted(np.concatenate(starts), offsets, "left")]
        return np.diff(at), np.concatenate(ids)

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], [np.zeros(0, np.uint32)]
        for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False):
            sizes.append(len(e.ids))
            if self.with_ids:
                ids.append(np.array(e.ids, np.uint32))
        return np.array(sizes, np.int64), np.concatenate(ids)


class SentenceCounts:
    """Numbers of tokens by a .model file of the sentencepiece library, which sees whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, None]:
        return np.array([len(x) for x in self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64), None


def load(path: str, with_ids: bool = True) -> Encoder | SentenceCounts:
    """The encoder of this Python worker; made once."""
    if (path, with_ids) not in _loaded:
        _loaded[path, with_ids] = SentenceCounts(path) if path.endswith(".model") else Encoder(path, with_ids)
    return _loaded[path, with_ids]


def ended(sizes: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids, each followed by ``end_id``, as little-endian unsigned 32-bit numbers, and where each text ends."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = ids
    return out, ends


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of about ``step_bytes`` bytes; a longer text is alone in its range."""
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return steps((sizes + 64).tolist(), step_bytes)


COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, step_bytes: int = STEP_BYTES) -> DataFrame:
    """``df`` with n_bytes (UTF-8) and n_tokens of every whole text; ids are never returned.

    ``tokenizer`` is the path of a .json (tokenizers) or .model (sentencepiece) file that every
    executor has. No begin, end or added special tokens, no truncation or padding; special strings
    inside texts are handled as the library does by default. Arrow batches are cut into steps of
    about ``step_bytes`` bytes, and long texts into windows that end at safe boundaries. A null or
    empty text has 0 bytes and 0 tokens. One row for each input row, repeated rows too; an empty table
    gives no rows. New columns replace input columns of the same name (in any case).
    """
    fresh = {n.lower() for n in COUNTS.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    # the text travels under a name of its own: a column kept may be it
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("_text_to_count"))
    schema = T.StructType([*source.schema.fields[:-1], *COUNTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            for a, b in text_steps(column, step_bytes):
                part = column.slice(a, b - a)
                n_tokens, _ = load(tokenizer, False).encode(part)
                n_bytes = pa.compute.binary_length(part).cast(pa.int64()).fill_null(0)
                passed = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*passed, n_bytes, pa.array(n_tokens)], names=schema.names)

    return source.mapInArrow(run, schema)

