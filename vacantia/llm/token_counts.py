"""Token counts by byte-level BPE, with a shortcut for pre-tokens that are one token."""

import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_pieces, remembered

# Fixed pattern of the byte-level pre-tokenizer.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Stretches with other characters go to the library: there, character classes may differ between libraries.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_VISIBLE = re.compile("[\x21-\x7e\xa1-ɏ]")
# Where a white space is more than one space between two visible characters, cutting at spaces would be wrong.
_LOOSE = re.compile(r"\s\x20|\x20\s|^\s|\s\Z")

# Remembered strings per Python worker; then the memory is emptied.
REMEMBERED = 400_000


def open_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as exactly one token, themselves: each is encoded to prove it.

    Only strings that the pre-tokenizer leaves in one piece count, as only those can meet a pre-token.
    """
    tokenizer = open_tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = sorted(tokenizer.get_vocab().items(), key=lambda kv: kv[1])
    texts = [tokenizer.decoder.decode([name]) for name, _ in names]
    alone = [(text, number) for text, (_, number) in zip(texts, names)
             if text and "�" not in text and text not in special and _PRETOKEN.fullmatch(text)
             and len(_PRETOKEN.findall(text)) == 1]
    codes = tokenizer.encode_batch([t for t, _ in alone], add_special_tokens=False)
    return frozenset(t for (t, number), code in zip(alone, codes) if code.ids == [number])


class _Counter(dict):
    """Tokens of a stretch of text that begins and ends where a pre-token does."""

    def __init__(self, path, whole):
        self.tokenizer, self.whole = open_tokenizer(path), whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, stretch):
        tokens = 0
        for pretoken in _PRETOKEN.findall(stretch):
            if pretoken in self.whole:
                tokens += 1
            else:
                tokens += len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[stretch] = tokens
        return tokens

    def count(self, text):
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _ODD.search(text):
            return sum(map(self._stretch, _stretches(text)))
        if _LOOSE.search(text):
            return sum(map(self.__getitem__, _PRETOKEN.findall(text)))
        first, *rest = text.split(" ")
        return self[first] + sum(map(self.__getitem__, [" " + r for r in rest]))


    def _stretch(self, stretch):
        if _ODD.search(stretch):
            return len(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, _PRETOKEN.findall(stretch))) if _LOOSE.search(stretch[1:]) else self[stretch]


def _stretches(text: str):
    """Cut a text before single spaces between two plain visible characters: a pre-token begins there, whatever else is in it."""
    words = text.split(" ")
    start = 0
    for i in range(1, len(words) + 1):
        if i == len(words) or (words[i - 1] and words[i] and _VISIBLE.match(words[i - 1][-1]) and _VISIBLE.match(words[i])):
            yield " " * (start > 0) + " ".join(words[start:i])
            start = i


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per document: UTF-8 bytes, tokens as the tokenizer file gives them, and whether they exceed ``limit``.

    Null texts count as empty, with 0 bytes and tokens. Every row gives one row, repeated and null keys included; other
    columns are not read. Special strings inside texts are special tokens, as is the library's default.
    """
    kind = docs.schema[key].dataType.simpleString()
    whole = whole_tokens(path)

    def work(batch):
        counter = remembered(("token counts", path), lambda: _Counter(path, whole))
        tokens = [counter.count(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tokens, pa.int64()), batch.column(2)], names=[key, "n_tokens", "n_bytes"])
    narrow = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    counted = map_pieces(narrow, text, f"`{key}` {kind}, n_tokens long, n_bytes long", work)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
