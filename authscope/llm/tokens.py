"""Token counts and token ids by public tokenizers, batch-encoded inside Arrow functions.

Texts are split at safe boundaries: white space that follows a character that isn't any. No pre-token of the
supported vocabularies runs over such a place, so tokens of the pieces, in order, are the tokens of the text.
Pieces repeat a great deal; each task encodes the distinct ones it hasn't met yet, in batches of equal bytes,
and keeps only their lengths (or packed ids) in a table of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_, not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from authscope.llm.common import UNICODE_SPACE, by_bytes, in_arrow, numbered, position, safe_blocks, slices

_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Texts with none of these characters are cut into pre-tokens right here: letters of Latin-1, digits, plain
#: white space and ASCII punctuation but for the apostrophe (contractions) and < (special tokens).
_ODD = re.compile(f"[^ \\t\\n{_LETTER}0-9!\"#$%&()*+,\\-./:;=>?@\\[\\\\\\]^_`{{|}}~]")
_PRE_BYTE = re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[^ \\t\\n{_LETTER}0-9]+|[ \\t\\n]+(?![^ \\t\\n])|[ \\t\\n]+")
_LEADING = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")
#: What stands between words of letters in texts without odd characters; for Arrow, bytes will do.
_NO_WORD = r"([0-9]|[!-/:-@\[-`{-~]+)"
#: There, a digit is a piece of its own if white space isn't any.
_PLAIN_BOUNDARY = re.compile("(?=[ \\t\\n0-9])")
#: Pieces that many are encoded of at once: words without white space, or behind a space.
_BARE_WORD, _LEADING_WORD = re.compile(f"[{_LETTER}]+"), re.compile(f" [{_LETTER}]+")
_TO_SPACE = {ord(c): " " for c in "\t\n\x0b\x0c\r"}

#: Pieces a task remembers at most, characters of one that is remembered, bytes of a batch and characters of a block.
REMEMBERED, REMEMBERED_CHARS, BATCH_BYTES, BLOCK_CHARS = 600_000, 64, 1 << 17, 1 << 20


def leading(text: str) -> list[str]:
    """Pieces that keep their leading white space; for byte-level vocabularies."""
    return (_LEADING if _ODD.search(text) else _PRE_BYTE).findall(text)


def bare(text: str) -> list[str]:
    """Pieces without white space; for lower-case vocabularies whose tokens never hold any."""
    return [x for x in text.translate(_TO_SPACE).split(" ") if x]


@lru_cache(maxsize=2)
def vocabulary(path: str, packed: bool):
    """(tokenizer, which ids end a word of those without white space, or begin one of those that keep it); once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    edge = (lambda token: token.endswith("</w>")) if packed else (lambda token: token.startswith("\u0120"))
    ids = tokenizer.get_vocab(with_added_tokens=True)
    edges = np.zeros(max(ids.values()) + 1, bool)
    edges[[i for token, i in ids.items() if edge(token)]] = True
    return tokenizer, edges


class Encoder:
    """Pieces -> one value each: the number of ids, or with `packed` the ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str, packed: bool):
        self.tokenizer, self.edge = vocabulary(path, packed)
        self.split, self.word, self.packed = (bare, _BARE_WORD, packed) if packed else (leading, _LEADING_WORD, packed)
        self.known: dict = {}

    def _value(self, ids):
        return np.array(ids, "<u4").tobytes() if self.packed else len(ids)

    def encode(self, pieces: list[str]) -> Iterator:
        for i, j in by_bytes(pieces, BATCH_BYTES):
            for e in self.tokenizer.encode_batch_fast(pieces[i:j], add_special_tokens=False):
                yield self._value(e.ids)

    def encode_words(self, words: list[str]) -> Iterator:
        """As encode(), for words of letters; many are encoded as one text and told apart by their edge ids."""
        for i, j in by_bytes(words, BATCH_BYTES):
            some = words[i:j]
            (e,) = self.tokenizer.encode_batch_fast([(" " if self.packed else "").join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(some):
                yield from self.encode(some)
            elif self.packed:
                data, at = ids.tobytes(), 0
                for end in (4 * (edges + 1)).tolist():
                    yield data[at:end]
                    at = end
            else:
                yield from np.diff(edges, append=len(ids)).tolist()

    def learn(self, new: Iterable[str]) -> dict:
        """Values of distinct pieces that aren't known; short ones are remembered."""
        new = sorted(new)
        word = list(map(self.word.fullmatch, new))
        words, other = list(compress(new, word)), list(compress(new, map(not_, word)))
        fresh = dict(zip(words, self.encode_words(words), strict=True)) | dict(zip(other, self.encode(other), strict=True))
        self.known.update(fresh)
        for x in [x for x in new if len(x) > REMEMBERED_CHARS]:
            del self.known[x]
        return fresh

    def texts(self, texts: list[str | None]) -> list:
        """The value of every whole text: the sum, or the ids joined."""
        long = [bool(t) and len(t) > BLOCK_CHARS for t in texts]
        out = self._values(["" if far else t or "" for t, far in zip(texts, long, strict=True)])
        for i in np.flatnonzero(long).tolist():  # block by block
            where = [_PLAIN_BOUNDARY] if self.packed and not _ODD.search(texts[i]) else []
            out[i] = self._join([self._values([block])[0] for block in safe_blocks(texts[i], BLOCK_CHARS, *where)])
        return out

    def _values(self, texts: list[str]) -> list:
        if len(self.known) > REMEMBERED:
            self.known = {}
        plain = [self.packed and not _ODD.search(t) for t in texts]
        held = [[] if easy else self.split(t) for t, easy in zip(texts, plain, strict=True)]
        fresh = self.learn(set().union(*held).difference(self.known))
        out = [self._look_up(pieces, fresh) for pieces in held]
        which = np.flatnonzero(plain).tolist()
        for i, ids in zip(which, self._plain([texts[i] for i in which]), strict=True):
            out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without odd characters. Arrow cuts them into words, digits and runs of punctuation and numbers
        the distinct ones, so that only these are looked up; NumPy lays their ids out text by text."""
        spaced = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.string()), _NO_WORD, r" \1 ")
        pieces = pc.ascii_split_whitespace(spaced)  # an empty piece where a text begins or ends with white space: no ids
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.known.get, distinct))
        gaps = list(compress(range(len(values)), map(is_, values, repeat(None))))
        fresh = self.learn([distinct[k] for k in gaps])
        for k in gaps:
            values[k] = fresh[distinct[k]]
        ids, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        data = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - each), each) + np.arange(each.sum())].tobytes()
        cuts = 4 * np.concatenate([[0], ends])[pieces.offsets.to_numpy()]
        return [data[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _look_up(self, pieces: list[str], fresh: dict):
        known = self.known
        try:
            return self._join([known[x] for x in pieces])
        except KeyError:
            return self._join([known[x] if x in known else fresh[x] for x in pieces])

    def _join(self, values: list):
        return b"".join(values) if self.packed else sum(values)


def counter(path: str) -> Callable[[list[str | None]], list[int]]:
    """texts -> numbers of tokens; .json by tokenizers, .model by sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    return Encoder(path, False).texts


def packer(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """texts -> ids, each little-endian unsigned 32-bit; for .json vocabularies whose tokens hold no white space."""
    return Encoder(path, True).texts


def count_tokens(docs: DataFrame, path: str, text: str = "text", batch_bytes: int = 1 << 21) -> DataFrame:
    """The other columns of docs with n_bytes (UTF-8) and n_tokens (long) of every whole text, in place of columns of those names.

    Null text counts as empty: 0 bytes, 0 tokens. Rows stay as they are, repeated ones too; an empty table gives an
    empty result. Long texts are encoded block by block; what is unpacked at once is bounded by bytes.
    """
    at = position(docs, text)
    keep = [i for i, c in enumerate(docs.columns) if i != at and c.lower() not in ("n_bytes", "n_tokens")]
    rows = numbered(docs).select(f"c{at}", *[f"c{i}" for i in keep])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches, 0, batch_bytes):
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes, pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=schema.names)

    return in_arrow(rows, run, schema).toDF(*[docs.columns[i] for i in keep], "n_bytes", "n_tokens")
