"""Exact token ids of whole texts from a public tokenizer, word by word.

Every token of the tokenizer lies inside one pre-token, no pre-token holds white space, added tokens
hold none either, and neither NFC nor per-character lower-casing looks across an ASCII white-space
character. So a text's ids are the concatenation of the ids of its ASCII-white-space-separated words.
Arrow splits texts and numbers their different words; each different word is looked up once a portion,
and a worker can keep the ids of words that it has met. `supports_words` checks these premises
against the tokenizer's own description; others are encoded whole.

A word of ASCII and Latin-1 letters alone is one pre-token as it is, once lower-cased (`supports_letters`), so
the tokenizer's model encodes it without the steps before it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from civicledger.llm.common import worker_memo

#: Words of each of a worker's two generations: when the younger is full, the older is forgotten. A portion may bring as many more.
#: With words of at most CACHE_WORD_BYTES and their ids an entry takes some 200 bytes, so a generation has some 40 MB. Bounds a worker's memory, not the result.
CACHE_WORDS = 100_000
#: Words longer than this many bytes are encoded but not kept.
CACHE_WORD_BYTES = 64
#: Bytes of texts whose words are looked up together, but for a longer text. Bounds a worker's memory, not the result.
PORTION = 4 << 20
#: Code points that are letters by Unicode and unchanged by NFC, lower-cased each by itself.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Neither letters, digits nor white space; no contraction or added token begins with one.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<")
#: A word without what may begin an added token, whose closing marks are pre-tokens of their own.
PARTED = rf"^([!-;=-~{LETTERS}]*[0-9{LETTERS}])?[{re.escape(MARKS)}]*$"
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_letters = re.compile(rf"[{LETTERS}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def supports_words(description: dict) -> bool:
    """True if splitting at ASCII white space cannot change the ids (see the module's text)."""
    norm = description.get("normalizer") or {}
    parts = norm.get("normalizers", [norm]) if norm else []
    lower = any(p.get("type") == "Lowercase" for p in parts)
    safe_norm = lower and all(p.get("type") in ("NFC", "Lowercase") or (p.get("type") == "Replace" and p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " ") for p in parts)
    pre = description.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = steps[0]
    drops_space = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and str(split.get("pattern", {}).get("Regex", "")).endswith("[^\\s\\p{L}\\p{N}]+")
    rest = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True) for s in steps[1:])
    added = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) and not any(c.isspace() for c in a["content"]) for a in description.get("added_tokens", []))
    return bool(safe_norm and drops_space and rest and added and not description.get("truncation") and not description.get("padding"))


def supports_letters(description: dict) -> bool:
    """True if a lower-cased word of LETTERS is one pre-token, and the tokens that end words are told by their suffix."""
    pre, model = description.get("pre_tokenizer") or {}, description["model"]
    split = (pre.get("pretokenizers") or [pre])[0]
    return bool(supports_words(description) and split.get("pattern") == {"Regex": SPLIT} and len(pre["pretokenizers"]) == 2 and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges"))


def load(name: str) -> tuple:
    """(tokenizer, whether words may be split, (the model for words of letters, which ids end a word) or None, [younger, older generation of word ids]) of this worker process."""
    def make() -> tuple:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = tokenizer_path(name)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        tok, letters = Tokenizer.from_file(path), None
        if supports_letters(description):
            vocab, suffix = description["model"]["vocab"], description["model"]["end_of_word_suffix"]
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[k for w, k in vocab.items() if w.endswith(suffix)]] = True
            model = Tokenizer(tok.model)
            model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            letters = (model, ends)
        return tok, supports_words(description), letters, [{}, {}]

    return worker_memo(f"tokens of {name}", make)


def _pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of at most PORTION bytes, or a row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")) - at)
        yield at, n
        at += n


def ids_of(texts: pa.Array | list[bytes], name: str) -> list[bytes]:
    """The ids of each UTF-8 text, four little-endian bytes each, without added special tokens."""
    tok, by_word, letters, known = load(name)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
    if not by_word:
        return [_pack(e.ids) for e in tok.encode_batch([t.decode("utf-8", "replace") for t in column.to_pylist()], add_special_tokens=False)]
    split = pc.ascii_split_whitespace(column.cast(pa.string(), safe=False))
    met = split.flatten().dictionary_encode()
    ids = _ids_of_words(met.dictionary, tok, letters, known).take(met.indices)
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    ends = at[split.offsets.to_numpy()].tolist()
    data = memoryview(ids.buffers()[2] or b"")
    return [data[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]


def _ids_of_words(words: pa.Array, tok, letters: tuple | None, known: list[dict]) -> pa.Array:
    """The ids of each of the words, as binaries. Where closing marks are pre-tokens of their own, a word's ids are its body's and theirs."""
    if letters is None:
        return _looked_up(words, tok, letters, known)
    parted = pc.match_substring_regex(words, PARTED)
    mask = parted.to_numpy(zero_copy_only=False)
    some, others = words.filter(parted), words.filter(pc.invert(parted))
    bodies = _looked_up(pc.utf8_lower(pc.ascii_rtrim(some, MARKS)), tok, letters, known)
    marks = _looked_up(pc.replace_substring_regex(some, rf"^.*[0-9{LETTERS}]", ""), tok, letters, known)
    both = pc.binary_join_element_wise(bodies, marks, pa.scalar(b"", pa.large_binary()))
    place = np.empty(len(mask), np.int64)
    place[mask] = np.arange(len(some))
    place[~mask] = np.arange(len(some), len(mask))
    return pa.concat_arrays([both, _looked_up(others, tok, letters, known)]).take(pa.array(place))


def _looked_up(words: pa.Array, tok, letters: tuple | None, known: list[dict]) -> pa.Array:
    """The ids of each of the words from what the worker has met, or from the tokenizer."""
    met = words.dictionary_encode()
    different = met.dictionary.cast(pa.binary()).to_pylist()
    if len(known[0]) > CACHE_WORDS:
        known[:] = [{}, known[0]]
    young, old = known
    missing = []
    for w in different:
        if w not in young:
            ids = old.get(w)
            if ids is None:
                missing.append(w)
            else:
                young[w] = ids
    plain = [w for w in missing if letters and _letters.fullmatch(w.decode("utf-8", "replace"))]
    rest = set(missing).difference(plain)
    if plain:
        young.update(_encode_letters(*letters, plain))
    young.update(_encode_words(tok, [w for w in rest if w.isascii()]))
    others = [w for w in rest if not w.isascii()]
    for i in range(0, len(others), 4096):
        part = others[i : i + 4096]
        for w, e in zip(part, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
            young[w] = _pack(e.ids)
    ids = pa.array([young[w] for w in different], pa.large_binary())
    for w in missing:
        if len(w) > CACHE_WORD_BYTES or len(young) > 2 * CACHE_WORDS:
            del young[w]
    return ids.take(met.indices)


def _encode_letters(model, ends: np.ndarray, words: list[bytes]):
    """(word, ids) of lower-case words of LETTERS, many in one text; a word ends where a token does that only ends words."""
    for i in range(0, len(words), 2048):
        part = words[i : i + 2048]
        ids = np.asarray(model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(ends[ids]) + 1).tolist()
        raw = ids.tobytes()
        for w, lo, hi in zip(part, [0, *stops[:-1]], stops, strict=True):  # raises if a word has no end
            yield w, raw[4 * lo : 4 * hi]


def _encode_words(tok, words: list[bytes]):
    """(word, ids) of ASCII words, many in one text; the tokens' offsets tell which word they belong to."""
    for i in range(0, len(words), 2048):
        part = words[i : i + 2048]
        e = tok.encode(b" ".join(part).decode("ascii"), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in part])
        first = np.searchsorted([o[0] for o in e.offsets], np.r_[0, ends])
        ids = np.asarray(e.ids, "<u4")
        for w, lo, hi in zip(part, first, first[1:]):
            yield w, ids[lo:hi].tobytes()
