"""Problem 8: the corpus as token ids of a public byte-level BPE.

Two neighbouring bytes that stand together inside no vocabulary token can never be merged: between them lies a
certain cut. Pieces of the pre-tokenizer are split at these cuts, the fragments encoded one by one and joined.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from marlspike.session import once

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers, and the longest it does.
REMEMBER, REMEMBER_LONGEST = 400_000, 64


class Fragments:
    """Encoder of one vocabulary in the rank format (token bytes in base 64, then the rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.inside = np.zeros((256, 256), bool)
        for token in self.ranks:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.cut_after = [frozenset(np.flatnonzero(~row).tolist()) for row in self.inside]
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[int]:
        """Places in ``piece`` that no token can span."""
        c = self.cut_after
        return [i for i in range(1, len(piece)) if piece[i] in c[piece[i - 1]]]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer: its fragments encoded independently, then concatenated."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last = 0
        for c in [*self.cuts(raw), len(raw)]:
            part = raw[last:c]
            last = c
            ids = self.fragments.get(part)
            if ids is None:
                one = self.ranks.get(part)
                ids = [one] if one is not None else self.core.encode_single_piece(part)
                if len(part) <= REMEMBER_LONGEST:
                    if len(self.fragments) >= REMEMBER:
                        self.fragments.clear()
                    self.fragments[part] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= REMEMBER_LONGEST:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def fragments(path: str) -> Fragments:
    """One encoder per worker and vocabulary."""
    return Fragments(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``doc_id``, ``ids``): one row per document; null and empty texts get an empty list.

    Texts are encoded whole where they are read, without a shuffle. Repeated rows count once: only if an id occurs
    twice (one aggregation of ids) are the rows themselves compared. Null ids are kept as they are.
    """
    path = os.path.join(folder, f"{tokenizer}.tiktoken")
    base = once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "doc_id")
    id_type = base.schema["doc_id"].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        enc = fragments(path)
        for b in batches:
            flat: list[int] = []
            offs = [0]
            for t in b.column("_t").to_pylist():
                flat += enc.encode(t)
                offs.append(len(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.array(flat, np.int32)))], names=["doc_id", "ids"])

    return base.mapInArrow(run, f"doc_id {id_type}, ids array<int>")
