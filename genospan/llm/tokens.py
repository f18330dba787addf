"""Token ids of whole texts with a public tokenizer file, remembered run by run.

A tokenizer that drops white space gives a text the ids of its blank-separated
pieces in a row, and a piece the ids of the runs its own pattern cuts it
into.  Runs repeat: each Python worker remembers a bounded number of them and asks the
tokenizer's model for the rest.  A tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from genospan.llm.runtime import worker_state
from genospan.llm.words import _SPACE, Words, gathered, scan_words, spread
from genospan.session import ship_by_value

ship_by_value(__name__)

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
REMEMBERED_RUNS = 300_000
LONGEST_REMEMBERED = 48  # bytes
TEXTS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20

# Fixed value: how the vocabulary's tokenizer cuts lower-cased text.
RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Pieces with control characters, tag-like marks or a capital sigma go through the tokenizer itself.
_SPECIAL = regex.compile(r"[\x00-\x1f\x7f-\x9f\p{Z}Σ]|<\|")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file lies on this machine; any other path may be given instead."""
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def packed(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


# Classes of the bytes of plain pieces: printable ASCII but the apostrophe, and the letters of U+00C0 to U+00FF.
_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = 0
_LEAD = 0xC3
_CLASS[_LEAD] = _LETTER
_SECOND = np.zeros(256, np.uint8)
_SECOND[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Ids of whole texts; those of a run or piece are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pattern = self._run_pattern()
        self.letters = byte_letters()

    def _run_pattern(self):
        """The pattern that cuts lower-cased text into runs, or None for tokenizers that keep white space or have another one."""
        spec = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        pattern = steps[0]["pattern"]["Regex"]
        return regex.compile(pattern) if pattern == RUN_PATTERN else None

    def _run(self, run: bytes) -> bytes:
        """Ids of a lower-cased run; when the dictionary is full, it starts anew and keeps what is asked for again."""
        ids = self.known.get(run)
        if ids is None:
            ids = self.older.get(run)
            if ids is None:
                ids = packed([t.id for t in self.tokenizer.model.tokenize(run.decode("latin1").translate(self.letters))])
            if len(run) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED_RUNS // 2:
                    self.older, self.known = self.known, {}
                self.known[run] = ids
        return ids

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece that is not plain."""
        text = piece.decode()
        if _SPECIAL.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(self._run(run.encode()) for run in self.pattern.findall(text.lower()))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some documents at a time, in their order: the ids of all, and where each document's begin and end.

        Plain pieces are cut into runs of one class by their bytes.  The distinct runs and other pieces of these documents are
        looked up once; numpy puts the ids together.
        """
        if self.pattern is None:
            for lo in range(0, len(column), TEXTS_AT_ONCE):
                texts = [t or "" for t in column.slice(lo, TEXTS_AT_ONCE).to_pylist()]
                found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
            return
        for part in scan_words(column, hashed=False, at_once=BYTES_AT_ONCE):
            starts, ends, odd, first = _units(part)
            code, ids = np.zeros(len(starts), np.int64), []
            lower = _LOWER[part.data]
            lower[1:][(part.data[:-1] == _LEAD) & (part.data[1:] < 0x9F)] += 32
            for side, data, find in ((~odd, lower, self._run), (odd, part.data, self._piece)):
                coded = gathered(data, starts[side], ends[side]).dictionary_encode()
                code[side] = coded.indices.to_numpy() + len(ids)
                ids += map(find, coded.dictionary.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint32)
            sizes = size[code]
            yield flat[spread(at[code], sizes)], np.concatenate([[0], np.cumsum(sizes)])[first]


def _units(part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Borders of the runs of plain pieces and of whole other pieces, which of them are other pieces, each document's first."""
    data = part.data
    after_lead = np.zeros(len(data), bool)
    after_lead[1:] = data[:-1] == _LEAD
    kind = np.where(after_lead, _SECOND[data], _CLASS[data])
    strange = kind == 0
    strange[1:] |= (data[1:] == ord("|")) & (data[:-1] == ord("<"))
    count = np.concatenate([[0], np.cumsum(strange)])
    odd_word = count[part.ends] > count[part.starts]
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # Only inside plain pieces.
    begins[spread(part.starts[odd_word], (part.ends - part.starts)[odd_word])] = False
    begins[part.starts] = True
    starts = np.flatnonzero(begins)
    starts = starts[~_SPACE[data[starts]]]
    word = np.searchsorted(part.starts, starts, side="right") - 1
    ends = np.minimum(part.ends[word], np.append(starts[1:], len(data)))
    return starts, ends, odd_word[word], np.searchsorted(starts, np.append(part.starts, len(data))[part.ptr])


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The encoder of this worker process for a vocabulary file.

    With ``specials_as_text`` the strings of special tokens in a text are ordinary text.
    """
    return worker_state(f"encoder_{path}_{specials_as_text}", lambda: Encoder(path, specials_as_text))
