"""Token counts with a public tokenizer, inside Arrow batch functions.

Texts are cut at *safe boundaries*: before a single space that stands
between two characters that are surely not white space. No token of the
byte-level pattern reaches over such a place, so the pieces' tokens are the
text's tokens, however long it is; a text longer than a slice is also taken
in parts that end there. Equal pieces, compared byte by byte, are encoded once
per worker and kept in a bounded cache, and only lengths leave the function.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectext import buffers, byte_slices, span_hashes

SLICE_BYTES = 1 << 20
#: The cache is emptied before it holds many more pieces or ids.
CACHE_PIECES = 500_000
CACHE_IDS = 16_000_000
#: The published pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE_BEFORE = np.zeros(256, dtype=bool)
_SAFE_BEFORE[0x21:0x7F] = True
_SAFE_BEFORE[0x80:] = True
#: Last bytes of white-space characters beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_SAFE_BEFORE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_SAFE_AFTER = np.zeros(256, dtype=bool)
_SAFE_AFTER[0x21:0x7F] = True
_SAFE_AFTER[0x80:] = True
#: First bytes of those characters.
_SAFE_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that begin a new token after a letter; none occurs in an added token that is found inside texts.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(x) for x in ".,;:!?*%$&#"]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces: each non-empty text's start, and all safe boundaries.

    Safe are a single space between two characters that aren't white space,
    and a mark right after a Latin letter.
    """
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, two_before = data[at - 1], data[np.maximum(at - 2, 0)]
    good = (_SAFE_BEFORE[before] | (before >= 0x80) & (two_before == 0xC3)) & _SAFE_AFTER[data[at + 1]]
    good &= ~first[np.minimum(at + 1, len(data) - 1)]
    first[at[good]] = True
    at = np.flatnonzero(_MARK[data])
    at = at[at > 0]
    before, two_before = data[at - 1], data[np.maximum(at - 2, 0)]
    good = _LETTER[before] | (before >= 0x80) & (two_before == 0xC3) & (before != 0x97) & (before != 0xB7)
    first[at[good]] = True
    return np.flatnonzero(first)


def safe_parts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that together are one text, of about ``most`` bytes where it has safe boundaries that near."""
    at = 0
    while at < len(data):
        to = at + most
        while to < len(data):
            # Two bytes before and one behind decide whether a place is safe.
            near = data[to - 2 : to + most]
            good = safe_starts(near, np.array([0, len(near)]))
            good = good[(good >= 2) & (good < len(near) - 1)]
            if len(good):
                to += int(good[0]) - 2
                break
            to += most - 2
        to = min(to, len(data))
        yield at, to
        at = to


def one_token_word(text: str) -> bool:
    """Whether the pattern surely takes ``text`` whole: letters of the Latin blocks with at most one space before."""
    word = text[1:] if text[:1] == " " else text
    return word.isalpha() and max(word) < "\u0250"


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}


def byte_level_codec(path: str):
    """The byte-level BPE of a tokenizer.json as a ``tiktoken`` encoding, or None if it is of another kind.

    Both libraries give the same ids for this kind; this one is some five
    times faster on short pieces. The file's added tokens keep their ids and
    are found inside texts, as the file's own library does by default.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    added = spec.get("added_tokens", [])
    if any(_MARK[b] or b == 0x20 for x in added for b in x["content"].encode()) or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    special = {x["content"]: x["id"] for x in added}
    of, vocab = byte_characters(), model["vocab"]
    # Ids stand for the order of merges here, so the file's merges must be in the order of ids.
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(set(made)) or len(made) + len(of) != len(vocab.keys() - special.keys()):
        return None
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: The published pattern of word-end BPE, whose matches are the words; white space is dropped.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_end_cuts(spec: dict) -> bool:
    """Whether a tokenizer.json encodes word by word, without white space, so that texts can be cut at safe boundaries.

    Letter runs, digits and runs of marks are words; the normalizers compose,
    lower-case and collapse white space, none of which reaches over a space.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    steps = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else []
    split = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("invert")) for x in steps[:1]]
    words = split == [("Split", WORD_END_PATTERN, "Removed", True)] and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
    norm = spec.get("normalizer") or {}
    forms = norm.get("normalizers", []) if norm.get("type") == "Sequence" else [norm] * bool(norm)
    local = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ") for x in forms)
    added = spec.get("added_tokens", [])
    plain = not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(_MARK[b] or b == 0x20 for x in added for b in x["content"].encode())
    return words and local and plain and model.get("type") == "BPE" and not model.get("dropout")


#: A byte that UTF-8 never has; it stands for the end of a word.
WORD_END = b"\xff"


def word_end_codec(spec: dict):
    """``encode_single_piece`` of a word-end BPE in ``tiktoken``, for lower-case words of Latin letters and WORD_END, or None if it is of another kind.

    The last character and the word's end are one token before any merge, and
    merges stand in the order of ids, so both libraries merge alike (tested
    over words, random and repetitive strings); this one is some seven times
    faster.
    """
    import tiktoken

    model, of = spec["model"], byte_characters()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    end = model.get("end_of_word_suffix")
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if not end or any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "byte_fallback")) or None in made or made != sorted(set(made)):
        return None
    single = {c + e for c in of for e in ("", end)}
    if not single <= vocab.keys() or len(single) + len(made) != len(vocab) or max(vocab[x] for x in single) > made[0]:
        return None
    ranks = {bytes(of[c] for c in t.removesuffix(end)) + WORD_END * t.endswith(end): i for t, i in vocab.items()}
    return tiktoken.Encoding("word_end", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class PieceEncoder:
    """Encodes pieces of text, each distinct one once while it stays in the cache."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split = False
        if path.endswith(".json"):
            if (codec := byte_level_codec(path)) is not None:
                self.split, special = True, codec.special_tokens_set
                whole = codec._core_bpe.encode_single_piece
                self.encode = lambda texts: [whole(x.encode()) if one_token_word(x) and x not in special else codec.encode(x, allowed_special="all") for x in texts]
            else:
                from tokenizers import Tokenizer

                own = Tokenizer.from_file(path)
                own.no_truncation()
                own.no_padding()
                whole = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
                with open(path, encoding="utf-8") as f:
                    spec = json.load(f)
                self.split = word_end_cuts(spec)
                word = word_end_codec(spec) if self.split else None
                self.encode = self._by_words(word, whole) if word else whole
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: own.encode(texts, num_threads=1)
        self.forget()

    @staticmethod
    def _by_words(word, whole):
        """Latin words by ``word``, all other pieces by ``whole``."""

        def encode(texts: list[str]) -> list[list[int]]:
            low = [x[x[:1] == " " :].lower() for x in texts]
            plain = [x.isalpha() and max(x) < "\u0250" for x in low]
            rest = iter(whole([x for x, p in zip(texts, plain) if not p]))
            return [word(x.encode() + WORD_END) if p else next(rest) for x, p in zip(low, plain)]

        return encode

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)
        self.n_ids = 0

    def _learn(self, texts: list[bytes]) -> None:
        for at in range(0, len(texts), 10_000):
            new = texts[at : at + 10_000]
            found = self.encode([x.decode("utf-8") for x in new])
            flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            n, m = len(self.known), len(found)
            for name, need in (("lengths", n + m), ("starts", n + m), ("ids", self.n_ids + len(flat))):
                if need > len(old := getattr(self, name)):
                    setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old)), dtype=old.dtype)]))
            self.lengths[n : n + m] = sizes
            self.starts[n : n + m] = self.n_ids + np.cumsum(sizes) - sizes
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            self.known.update(zip(new, range(n, n + m)))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cache entry of every piece, and each text's first piece (n + 1 entries)."""
        if len(self.known) > CACHE_PIECES or self.n_ids > CACHE_IDS:
            self.forget()
        starts = safe_starts(data, offsets) if self.split else np.unique(offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        _, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        # The pieces lie end to end, so this lays the first of each hash beside them.
        first = np.arange(len(data)) + np.repeat(starts[index][inverse] - starts, ends - starts)
        if not ((ends - starts)[index][inverse] == ends - starts).all() or not (data[np.minimum(first, len(data) - 1)] == data).all():
            index = inverse = np.arange(len(starts))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        entry = np.fromiter(map(self.known.get, texts, repeat(-1)), dtype=np.int64, count=len(texts))
        if len(new := np.flatnonzero(entry < 0)):
            self._learn(list(dict.fromkeys(texts[i] for i in new.tolist())))
            entry[new] = [self.known[texts[i]] for i in new.tolist()]
        return entry[inverse], np.searchsorted(starts, offsets)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts as they are, or the parts of a single long one."""
        if self.split and len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
            for a, b in safe_parts(data, SLICE_BYTES):
                yield data[a:b], np.array([0, b - a])
        else:
            yield data, offsets

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = np.zeros(len(offsets) - 1, dtype=np.int64)
        for part, bounds in self._parts(data, offsets):
            entry, first = self.pieces(part, bounds)
            total = np.concatenate([[0], np.cumsum(self.lengths[entry])])
            n += total[first[1:]] - total[first[:-1]]
        return n

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and each text's first (n + 1 entries)."""
        found = []
        for part, bounds in self._parts(data, offsets):
            entry, first = self.pieces(part, bounds)
            lengths = self.lengths[entry]
            total = np.concatenate([[0], np.cumsum(lengths)])
            at = np.arange(total[-1]) + np.repeat(self.starts[entry] - total[:-1], lengths)
            found.append((self.ids[at], total[first]))
        return found[0] if len(found) == 1 else (ids := np.concatenate([x for x, _ in found]), np.array([0, len(ids)]))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder; it outlives a task where Spark reuses workers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, *, path: str, text_col: str = "text", limit: int = 512, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to ``docs``, in one pass without a shuffle.

    A null or empty text has 0 bytes and 0 tokens. Columns of those names
    that ``docs`` has already are replaced. Repeated rows stay repeated.
    """
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    kept = [c for c in docs.columns if c.lower() not in added and c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(k, v) for k, v in added.items())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(len(kept))
            for at, to in byte_slices(texts, slice_bytes):
                data, offsets = buffers(texts.slice(at, to - at))
                n = own.counts(data, offsets)
                columns = [batch.column(i).slice(at, to - at) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string")).mapInArrow(count, schema)
