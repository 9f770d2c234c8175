"""Token counts and token ids with public tokenizer files.

The library that a file belongs to decides the ids: tokenizers for .json, sentencepiece for .model.
A byte-level BPE file is also loaded into tiktoken, which gives the same ids several times faster; it is
used only where the two are bound to agree (see Encoder), everything else goes to the file's own library.
Texts are handed to either in batches.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.textio import id_and_text, slices_by_bytes, text_buffer, text_offsets

#: First UTF-8 byte of U+0500. Letters below it have had the same Unicode classes for decades, so that the regular-expression engines of both libraries cut them alike.
_FIRST_RARE_BYTE = 0xD4
_LONG_SPACE = re.compile(r"\s{4096}")
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare name means a file of public_tokenizers on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_level_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_safely(text: str, limit: int) -> Iterator[str]:
    """Pieces of about `limit` characters, cut only before a blank or line end that follows an ASCII letter or digit.

    Byte-level pre-tokenizers never put a letter or digit and a blank behind it into one token, and the run of
    blanks moves whole into the next piece, so the pieces' tokens are the text's tokens. A text without such a
    place in reach stays whole up to the next one.
    """
    start = 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Ids of texts without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.path, self.kind = path, os.path.splitext(path)[1]
        self.fast, self.byte_level = None, False
        if self.kind == ".model":
            return
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self.byte_level:
            self.fast = self._tiktoken(spec)

    @functools.cached_property
    def slow(self):
        """The file's own library, loaded when a text first needs it: every worker that is kept alive would hold it."""
        if self.kind == ".model":
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=self.path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.path)
        slow.no_truncation()
        slow.no_padding()
        return slow

    @staticmethod
    def _tiktoken(spec: dict):
        """The same vocabulary in tiktoken, or None where ids are not in the order of the merges."""
        try:
            import tiktoken
            from public_tokenizers import PATTERN
        except ImportError:  # the library of the file does the work alone
            return None
        vocab, to_byte = spec["model"]["vocab"], _byte_level_alphabet()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ids = [vocab[m] for m in merged]
        if ids != sorted(ids) or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            return None
        ranks = {bytes(to_byte[c] for c in piece): k for piece, k in vocab.items() if piece not in added}
        return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str, common: bool) -> np.ndarray:
        """uint32 ids of one text. common: none of its characters is U+0500 or higher."""
        if self._quick(text, common):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.kind == ".model":
            return np.asarray(self.slow.encode(text, num_threads=1), np.uint32)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _quick(self, text: str, common: bool) -> bool:
        return self.fast is not None and common and not (len(text) > 4096 and _LONG_SPACE.search(text))

    def lengths(self, texts: list[str], common: list[bool], limit: int = 1 << 16) -> np.ndarray:
        """How many ids each text has, by one call of each library for all of them; long texts go in pieces where the tokenizer allows that."""
        pieces: tuple[list[str], list[str]] = ([], [])
        owner: tuple[list[int], list[int]] = ([], [])
        for k, (text, plain) in enumerate(zip(texts, common, strict=True)):
            for piece in split_safely(text, limit) if self.byte_level and len(text) > limit else (text,):
                quick = bool(self._quick(piece, plain))
                pieces[quick].append(piece)
                owner[quick].append(k)
        out = np.zeros(len(texts), np.int64)
        if pieces[1]:
            np.add.at(out, owner[1], [len(x) for x in self.fast.encode_batch(pieces[1], num_threads=1, allowed_special="all")])
        if pieces[0] and self.kind == ".model":
            np.add.at(out, owner[0], [len(x) for x in self.slow.encode(pieces[0], num_threads=1)])
        elif pieces[0]:
            np.add.at(out, owner[0], [len(x.ids) for x in self.slow.encode_batch_fast(pieces[0], add_special_tokens=False)])
        return out

    def ids_in_pieces(self, text: str, common: bool, limit: int = 1 << 16) -> np.ndarray:
        """As ids(), a long text piece by piece where its tokenizer allows that."""
        if len(text) <= limit or not self.byte_level:
            return self.ids(text, common)
        return np.concatenate([self.ids(x, common) for x in split_safely(text, limit)])


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer_path(name))


def encoded(texts: pa.Array, name: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every row of a string array; a null counts as empty. Work goes on in ranges balanced by bytes."""
    enc, offsets, data = encoder(name), text_offsets(texts), text_buffer(texts)
    for start, stop in slices_by_bytes(texts, max_bytes, 4096):
        part = data[offsets[start] : offsets[stop]]
        plain = not len(part) or part.max() < _FIRST_RARE_BYTE
        for row, text in enumerate(texts.slice(start, stop - start).to_pylist(), start):
            if not text:
                yield row, np.zeros(0, np.uint32)
                continue
            own = data[offsets[row] : offsets[row + 1]]
            yield row, enc.ids_in_pieces(text, plain or own.max() < _FIRST_RARE_BYTE)


def counted(texts: pa.Array, name: str, max_bytes: int = 1 << 20) -> np.ndarray:
    """Number of ids of every row of a string array; a null counts as empty. Batches are balanced by bytes."""
    enc, offsets, data = encoder(name), text_offsets(texts), text_buffer(texts)
    out = np.zeros(len(texts), np.int64)
    for start, stop in slices_by_bytes(texts, max_bytes, 4096):
        part = data[offsets[start] : offsets[stop]]
        plain = not len(part) or part.max() < _FIRST_RARE_BYTE
        rows = [(row, text) for row, text in enumerate(texts.slice(start, stop - start).to_pylist(), start) if text]
        common = [plain or data[offsets[row] : offsets[row + 1]].max() < _FIRST_RARE_BYTE for row, _ in rows]
        out[np.array([row for row, _ in rows], np.int64)] = enc.lengths([text for _, text in rows], common)
    return out


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    One narrow pass in Arrow batches that return lengths only. Null and empty texts have 0 bytes and 0 tokens,
    repeated rows and ids stay as they are, an empty table gives an empty result, other columns are ignored.
    Texts of any length are encoded whole: long ones piece by piece, cut where no token can cross.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            texts = batch.column(1)
            offsets = text_offsets(texts)
            n = counted(texts, tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
