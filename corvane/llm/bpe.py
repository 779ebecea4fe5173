"""BPE encoding and decoding with content-defined chunk reuse.

A rolling polynomial hash over code points cuts each text into chunks, so that passages which
documents share are cut at the same places wherever they stand. Documents are routed by their
smallest chunk hash (a min-hash: documents that share chunks probably share it), so copies and near
copies meet in one task, whose chunk store encodes each distinct chunk once. A chunk is encoded only
between its first and last *anchor*, a place no token can cross. Where two chunks join, the text
between the last anchor of the left and the first of the right is re-encoded as a whole; if the right
one has no anchor, the window grows by it, until an anchor on both sides proves exact agreement with
the encoding of the whole text.

Anchors follow from the tokenizer's own file:

``drop``   the pre-tokenizer drops white space: every white-space character is an anchor.
``lead``   byte-level pre-tokenizer with leading spaces: an anchor is before white space that
           follows something else.
``whole``  anything else: no anchors, so each text is one window.

Between anchors, pieces go through a bounded memo in front of the library's encoder.

Nulls are encoded as the empty text (no tokens); equal rows stay equal rows; other columns of the input
are not returned, except those named in ``keep``. Texts of any length are whole; the stores are
emptied when they reach their limits, and at the end of each task, which costs time, never results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import prepare

WINDOW, MULTIPLIER = 16, np.uint32(0x9E3779B1)
_SPACE_PIECES = re.compile(r"\s*\S+|\s+")
_LETTERS_DIGIT_REST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIMPLE_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_NOT_WHITE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to a tokenizer


def cut_points(texts: list[str], average: int = 512, least: int = 64, most: int = 8192) -> list[list[int]]:
    """Ends of each text's chunks. A cut depends on the WINDOW code points before it alone, but for
    the two size limits."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = max(1, average.bit_length() - 1)
    with np.errstate(over="ignore"):
        h = (joined + np.uint32(1)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        step, power = 1, MULTIPLIER
        while step < WINDOW:
            nxt = h * power
            nxt[step:] += h[:-step]
            h, step, power = nxt, step * 2, power * power
    found = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, base = [], 0
    for text in texts:
        n, cuts, last = len(text), [], 0
        lo, hi = np.searchsorted(found, (base + WINDOW, base + n))
        for c in (found[lo:hi] - base).tolist():
            if c - last < least:
                continue
            while c - last > most:
                cuts.append(last := last + most)
            cuts.append(last := c)
        while n - last > most:
            cuts.append(last := last + most)
        if n > last:
            cuts.append(n)
        out.append(cuts)
        base += n
    return out


def route(text: str, cuts: list[int]) -> int:
    """The smallest chunk hash, as a signed long; 0 for an empty text."""
    least, last = 1 << 64, 0
    for c in cuts:
        least, last = min(least, xxhash.xxh3_64_intdigest(text[last:c])), c
    return 0 if not cuts else least - (1 << 64) if least >= 1 << 63 else least


class Codec:
    """One tokenizer with its piece memo and chunk store; one per Python worker, which keeps the tokenizer from task to task."""

    def __init__(self, path: str, memo_pieces: int = 200_000, store_chars: int = 16_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.mode, joins = anchor_mode(spec := json.load(f)), spec.get("decoder") is None
        self.tokens = None
        if joins:  # without a decoder the library joins token strings with spaces
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.simple = None
        if self.mode == "drop" and self.tokens is not None:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if "pretokenizers" in spec["pre_tokenizer"] else ""
            if pattern == _LETTERS_DIGIT_REST and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.simple = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-;=-@\\[-`{-~]+")
        self.table = {i: c for i, c in enumerate(_byte_letters())}
        self.memo_pieces, self.store_chars = memo_pieces, store_chars
        self.forget()

    def forget(self) -> None:
        """Empty the memo and the store: a worker outlives its task, and what it keeps is memory that its executor's other work lacks."""
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.old: tuple[dict, dict] = ({}, {})
        self.parts: dict[str, tuple[bytes, str]] = {}
        self.store: dict[str, tuple] = {}
        self.stored = 0

    def learn(self, pieces: list[str]) -> None:
        """Encode the pieces that the memo lacks. The memo has two generations; the older one is dropped when the newer is full."""
        known = self.ids
        new = [p for p in set(pieces) if p not in known]
        if not new:
            return
        if len(known) + len(new) > self.memo_pieces:
            self.old = (known, self.said)
            known, self.said = {}, {}
            self.ids = known
            new = list(set(pieces))
        (old_ids, old_said), rest, simple, said = self.old, [], self.simple, self.said
        for p in new:
            if p in old_ids:
                known[p] = old_ids[p]
                if self.tokens is not None:
                    said[p] = old_said[p]
            elif simple is not None and simple.fullmatch(p):
                known[p], said[p] = self.spell(p)
            else:
                rest.append(p)
        if rest:
            for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
                ids = e.ids
                known[p] = array("I", ids).tobytes()
                if self.tokens is not None:
                    said[p] = " ".join([self.tokens[i] for i in ids])

    def spell(self, piece: str) -> tuple[bytes, str]:
        """A piece of Latin-1 letters, digits and ASCII marks through the library's BPE model alone: what
        normalising and splitting do to such a piece is plain (marks never include ' or <)."""
        parts, ids, said = self.parts, [], []
        for part in _SIMPLE_PARTS.findall(piece.lower()):
            got = parts.get(part)
            if got is None:
                if len(parts) > self.memo_pieces:
                    parts.clear()
                word = part if part.isascii() else part.encode().decode("latin-1").translate(self.table)
                t = [x.id for x in self.tokenizer.model.tokenize(word)]
                got = parts[part] = array("I", t).tobytes(), " ".join([self.tokens[i] for i in t])
            ids.append(got[0])
            said.append(got[1])
        return b"".join(ids), " ".join(said)

    def pieces(self, text: str) -> list[str]:
        if self.mode == "drop":
            return text.split() if not _NOT_WHITE.search(text) else re.findall(r"[^ \t\n\r]+", text)
        return _SPACE_PIECES.findall(text) if self.mode == "lead" else [text]

    def window(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of what lies between two anchors."""
        pieces = self.pieces(text)
        self.learn(pieces)
        ids = b"".join(map(self.ids.__getitem__, pieces))
        return ids, " ".join(filter(None, map(self.said.__getitem__, pieces))) if self.tokens is not None else ""

    def chunk(self, text: str) -> tuple[str, bytes, str, str] | None:
        """Text before the first anchor, ids and decoded text of the middle, text after the last anchor; None without an anchor."""
        if self.mode == "whole":
            return None
        pieces = self.pieces(text)
        if self.mode == "drop":
            head = pieces.pop(0) if pieces and not _white(text[0]) else ""
            if len(head) == len(text):
                return None
            tail = pieces.pop() if pieces and not _white(text[-1]) else ""
        elif len(pieces) < 2:
            return None
        else:
            head, tail = pieces.pop(0), pieces.pop()
        self.learn(pieces)
        ids = b"".join(map(self.ids.__getitem__, pieces))
        said = " ".join(filter(None, map(self.said.__getitem__, pieces))) if self.tokens is not None else ""
        return head, ids, said, tail

    def encode(self, text: str, cuts: list[int]) -> tuple[bytes, str, int]:
        """Ids as little-endian 32-bit integers, decoded text, chunks taken from the store."""
        ids, said, carry, last, reused = [], [], "", 0, 0
        for c in cuts:
            part, last = text[last:c], c
            got = self.store.get(part, self)
            if got is self:
                got = self.chunk(part)
                self.stored += len(part)
                if self.stored > self.store_chars:
                    self.store.clear()
                    self.stored = len(part)
                self.store[part] = got
            else:
                reused += 1
            if got is None:
                carry += part
                continue
            head, mid, mid_said, tail = got
            if carry or head:
                a, b = self.window(carry + head)
                ids.append(a)
                said.append(b)
            ids.append(mid)
            said.append(mid_said)
            carry = tail
        if carry:
            a, b = self.window(carry)
            ids.append(a)
            said.append(b)
        out = b"".join(ids)
        return out, " ".join(filter(None, said)) if self.tokens is not None else self.decode(out), reused

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(array("I", ids).tolist(), skip_special_tokens=False)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _white(c: str) -> bool:
    return c in " \t\n\r" or (c.isspace() and c not in "\x1c\x1d\x1e\x1f")


def anchor_mode(spec: dict) -> str:
    """What a tokenizer's JSON proves about places that no token can cross."""
    added = spec.get("added_tokens") or []
    if any(re.search(r"\s", a["content"]) or a.get("lstrip") or a.get("rstrip") for a in added) or (spec.get("model") or {}).get("dropout"):
        return "whole"

    def flat(x: dict | None, key: str) -> list[dict]:
        return [] if not x else [z for y in x[key] for z in flat(y, key)] if x.get("type") == "Sequence" else [x]

    norm, pre = flat(spec.get("normalizer"), "normalizers"), flat(spec.get("pre_tokenizer"), "pretokenizers")
    if any(n["type"] not in ("NFC", "Lowercase", "Replace") for n in norm) or any(n["type"] == "Replace" and (n["pattern"].get("Regex"), n["content"]) != (r"\s+", " ") for n in norm):
        return "whole"
    if pre and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]:
        pattern = pre[0]["pattern"].get("Regex", "")
        plain = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]\+|\[\\p\{L\}\]\+|\[\\p\{N\}\]|'[a-z]{1,2}", "", pattern)
        rest = all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in pre[1:])
        return "drop" if rest and set(plain) <= {"|"} else "whole"
    if not norm and len(pre) == 1 and pre[0]["type"] == "ByteLevel" and pre[0].get("use_regex", True) and not pre[0].get("add_prefix_space"):
        return "lead"
    return "whole"


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), digest: bool = False, average_chunk: int = 512) -> DataFrame:
    """Token ids and decoded text of every row of ``docs``.

    Returns key, the columns in ``keep``, n_tokens long, n_chunks and n_reused long, then ``ids``
    array<int> and ``decoded`` string, or with ``digest`` ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the UTF-8 bytes), both as lowercase hex. One row for
    each row of the input, in no order; null texts count as empty; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    fields = [F.col(key).alias("k"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("t")]
    src = docs.select(*fields)
    kept = [f for f in src.schema.fields if f.name != "t"]
    declared = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("t").to_pylist()
                cuts = cut_points(texts, average_chunk)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([np.array(c, dtype=np.int32).tobytes() for c in cuts], pa.binary()), pa.array([route(t, c) for t, c in zip(texts, cuts)], pa.int64())],
                    [*batch.schema.names, "cuts", "route"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(tokenizer_path)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    n, chunks, reused, first, second = [], [], [], [], []
                    for t, c in zip(batch.column("t").to_pylist(), batch.column("cuts").to_pylist()):
                        cuts = np.frombuffer(c, dtype=np.int32).tolist()
                        ids, said, again = it.encode(t, cuts)
                        n.append(len(ids) // 4)
                        chunks.append(len(cuts))
                        reused.append(again)
                        first.append(hashlib.sha256(ids).hexdigest() if digest else np.frombuffer(ids, dtype="<i4"))
                        second.append(hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest() if digest else said)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(f.name) for f in kept], pa.array(n, pa.int64()), pa.array(chunks, pa.int64()), pa.array(reused, pa.int64()), pa.array(first, pa.string() if digest else pa.list_(pa.int32())), pa.array(second, pa.string())],
                        [*[f.name for f in kept], "n_tokens", "n_chunks", "n_reused", "a", "b"],
                    )
        finally:
            it.forget()

    where = src.mapInArrow(routed, f"{declared}, t string, cuts binary, route long")
    # Rebalancing, unlike a plain repartition, splits a partition that many copies of one text swell.
    where = where.hint("rebalance", F.col("route")).drop("route")
    out = where.mapInArrow(encoded, f"{declared}, n_tokens long, n_chunks long, n_reused long, a {'string' if digest else 'array<int>'}, b string")
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return out.select(F.col("k").alias(key), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]), "n_chunks", "n_reused")
