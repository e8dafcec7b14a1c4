"""Token ids of texts by a given tokenizer file, with a cache by pre-token.

Pre-tokens never cross white space, so a text's ids are those of its words.
In texts in Latin script one pattern cuts a word into pre-tokens, which the
tokenizer's model takes byte by byte as its own rules would hand them over;
the ids of pre-tokens and of words are cached.
Any other text, and any with the marks of special tokens, goes to the
tokenizer whole, so all ids are the tokenizer's.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache
from itertools import islice

#: Entries of a cache; a full one keeps its older half, for frequent words come early.
MOST_CACHED = 800_000

#: Characters whose case, form and class the pattern below and the tokenizer's own rules see alike.
_PLAIN = "\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧₠-₿"
_OTHER = re.compile(rf"[^{_PLAIN}]|<\|")
_MARKS = re.escape("".join(c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20C0)]) if not c.isalnum() and not c.isspace()))
_PIECE = re.compile(rf"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[{_MARKS}]+")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


_NAMES = _byte_names()


@lru_cache(2)
def _caches(path: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Ids by pre-token and by word."""
    return {}, {}


def _cuttable(path: str) -> bool:
    """Whether the tokenizer's own rules are those that the pattern above stands for."""
    return _rules(path)


@lru_cache(2)
def _rules(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    normal = [n.get("type") for n in (own.get("normalizer") or {}).get("normalizers", [])]
    cuts = ((own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])
    wanted = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    whole = [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
    return normal == ["NFC", "Replace", "Lowercase"] and whole and cuts[0].get("pattern") == {"Regex": wanted} and not own.get("post_processor")


def encode(texts: list[str], path: str, cached: int = MOST_CACHED) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers."""
    t, (pieces, words) = _tokenizer(path), _caches(path)
    model = t.model
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    out: list[bytes | None] = [None] * len(texts)
    cut: list[tuple[int, list[str]]] = []
    whole: list[int] = []
    for i, x in enumerate(texts):
        if _cuttable(path) and not _OTHER.search(x):
            cut.append((i, x.lower().split()))
        else:
            whole.append(i)
    for cache in (pieces, words):
        if len(cache) > cached:
            old = dict(islice(cache.items(), cached // 2))
            cache.clear()
            cache.update(old)
    fresh = {w: _PIECE.findall(w) for w in set().union(*(own for _, own in cut)).difference(words)}
    for p in set().union(*fresh.values()).difference(pieces):
        name = p if p.isascii() else "".join([_NAMES[b] for b in p.encode()])
        pieces[p] = packed([k.id for k in model.tokenize(name)])
    words.update((w, b"".join([pieces[p] for p in own])) for w, own in fresh.items())
    for i, own in cut:
        out[i] = b"".join(map(words.__getitem__, own))
    for i in whole:
        out[i] = packed(t.encode(texts[i], add_special_tokens=False).ids)
    return out  # type: ignore[return-value]
