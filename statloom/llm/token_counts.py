"""Token counts of a byte-level BPE tokenizer with the whole-token shortcut."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of characters whose classes no version of Unicode has changed; others are left to the library.
SETTLED = r"[\x00-\x1b\x20-\u017f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20ac\u4e00-\u9fa5]*+"
#: Pre-tokens whose counts a task remembers beyond the vocabulary; it bounds memory only.
REMEMBERED = 500_000
#: Documents encoded before the counts go back.
SLICE = 500


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def whole_tokens(model: dict) -> set[str]:
    """Vocabulary strings that the merges turn into one token when they stand alone as a pre-token.

    Proved by running the merges of each string on its own, lowest rank first: a string is in the set
    only if a single piece is left. Strings that are not valid UTF-8 cannot be pre-tokens of a text.
    """
    letters = byte_letters()
    ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    alone = set()
    for token in model["vocab"]:
        parts = list(token)
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1 and all(c in letters for c in token):
            try:
                alone.add(bytes(letters[c] for c in token).decode())
            except UnicodeDecodeError:
                pass
    return alone


class Merged(dict):
    """Tokens of a pre-token: 1 for whole tokens, and for others what the merges leave, remembered."""

    def __init__(self, library: Tokenizer, alone: Iterable[str]) -> None:
        super().__init__(dict.fromkeys(alone, 1))
        self.library = library

    def __missing__(self, part: str) -> int:
        found = self[part] = len(self.library.encode(part, add_special_tokens=False))
        return found


class TokenCounter:
    """Counts tokens of texts as the tokenizer's own library does."""

    def __init__(self, definition: str, alone: Iterable[str]) -> None:
        spec = json.loads(definition)
        before = spec["pre_tokenizer"] or {}
        if (
            spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["model"].get("dropout")
        ):
            raise ValueError("only byte-level BPE without normalizer, prefix space and dropout is supported")
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.alone = alone
        self.known = Merged(self.library, alone)
        self.split = regex.compile(PATTERN).findall
        # Added tokens are found before anything else; their surroundings are encoded as ever.
        self.added = [t["content"] for t in spec["added_tokens"]]
        # Characters whose class may differ between Unicode versions leave the text to the library.
        self.plain = regex.compile(SETTLED).fullmatch

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(t in text for t in self.added) or not self.plain(text):
            return len(self.library.encode(text, add_special_tokens=False))
        if len(self.known) > len(self.alone) + REMEMBERED:
            self.known = Merged(self.library, self.alone)
        return sum(map(self.known.__getitem__, self.split(text)))


@lru_cache(maxsize=1)
def counter_of(definition: str, alone: frozenset[str]) -> TokenCounter:
    """The counter of a worker process, which serves one task after another."""
    return TokenCounter(definition, alone)


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    Counts equal those of the tokenizers library for the file (byte-level BPE), without begin, end or
    added tokens; strings of added tokens inside a text count as the library reads them. The file is
    read once, on the driver. A null or empty text counts 0. Rows are neither lost nor merged; a null
    doc_id stays null; other columns are ignored; texts are counted whole.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    shared = documents.sparkSession.sparkContext.broadcast((definition, frozenset(whole_tokens(json.loads(definition)["model"]))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                counts = [counter.count(t.as_py()) for t in batch["text"]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    data = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"))
    counted = data.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
