"""Byte-level BPE in Arrow functions: token counts and token ids of whole texts.

Texts are taken in batches of about equal bytes, and a long text is cut into parts at
places where no token can reach across, so neither a run of long texts nor one huge text
decides the memory of a task.  Counting hands every batch to the batch call of its library.  A cut lies between an ASCII letter or digit and a following
space: the split rule of the vocabulary never joins a word and the space behind it, and a part
that ends in a word leaves the look-ahead of white space unchanged.

The ``.tiktoken`` file holds the same merges as the ``.json`` file and is about four times
faster; it encodes every text whose characters all lie below U+0280.  Other texts go through
the ``tokenizers`` library and the ``.json`` file itself, so that no difference between the
character tables of the two libraries can show.  Special strings inside a text become their
special token, the default of ``tokenizers``.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

VOCABULARY = "byte_bpe_50k"
#: bytes handed to the encoder at a time; also the length above which a text is cut
BATCH_BYTES = 1 << 18
#: texts cut and batched together when only their lengths are wanted
GROUP_BYTES = 1 << 21
_BREAK = re.compile(r"(?<=[A-Za-z0-9])(?= )", re.ASCII)


@functools.lru_cache(maxsize=4)
def _encoders(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public.path(f"{name}.json"))
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    with open(public.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return exact, fast


def parts(text: str, size: int = BATCH_BYTES) -> list[str]:
    """Cut ``text`` at safe places into parts of about ``size`` characters; joined they are the text."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = _BREAK.search(text, begin + size)
        if found is None:
            break
        out.append(text[begin:found.start()])
        begin = found.start()
    out.append(text[begin:])
    return out


def encode(texts: list[str], plain: bool, name: str = VOCABULARY) -> list[np.ndarray]:
    """Ids of whole texts.  ``plain``: all characters lie below U+0280."""
    exact, fast = _encoders(name)
    out = []
    for text in texts:
        pieces = parts(text)
        if plain:
            ids = [fast.encode_to_numpy(p, allowed_special="all") for p in pieces]
        else:
            ids = [np.array(e.ids, np.uint32) for e in exact.encode_batch_fast(pieces, add_special_tokens=False)]
        out.append((ids[0] if len(ids) == 1 else np.concatenate(ids)).astype("<u4", copy=False))
    return out


def encoded(column: pa.Array, name: str = VOCABULARY) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of the rows from there on), in groups of about ``BATCH_BYTES``."""
    data, at = words.texts_of(column)
    for lo, hi in words.groups_of_bytes(at, BATCH_BYTES):
        raw = data[at[lo]:at[hi]]
        wide = np.flatnonzero(raw >= 0xCA)
        odd = set((np.searchsorted(at, wide + at[lo], "right") - 1).tolist()) if len(wide) else ()
        whole = raw.tobytes()
        texts = [whole[at[i] - at[lo]:at[i + 1] - at[lo]].decode("utf-8") for i in range(lo, hi)]
        yield lo, [encode([t], lo + k not in odd, name)[0] for k, t in enumerate(texts)]


def balanced(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut consecutive items into ranges of about equal bytes, as few as ``most`` bytes each allow.

    An item lies in the range its middle byte falls into; ranges without an item are left out.
    """
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total == 0:
        return []
    ranges = -(-total // most)
    place = np.minimum((2 * ends - sizes) * ranges // (2 * total), ranges - 1)
    border = np.searchsorted(place, np.arange(ranges + 1))
    return [(int(a), int(b)) for a, b in zip(border, border[1:]) if b > a]


def lengths(column: pa.Array, name: str = VOCABULARY) -> np.ndarray:
    """The number of tokens of every text of a column.

    The texts are cut into parts, the parts are batched by bytes, and of each batch the parts
    below the border of the character tables and the others are one library call each.
    """
    exact, fast = _encoders(name)
    data, at = words.texts_of(column)
    out = np.zeros(len(at) - 1, np.int64)
    wide = np.zeros(len(at) - 1, bool)
    wide[np.searchsorted(at, np.flatnonzero(data >= 0xCA), "right") - 1] = True
    whole = data.tobytes()
    for lo, hi in words.groups_of_bytes(at, GROUP_BYTES):
        cut = [parts(whole[at[i]:at[i + 1]].decode("utf-8")) for i in range(lo, hi)]
        owner = np.repeat(np.arange(lo, hi), [len(c) for c in cut])
        pieces = [piece for c in cut for piece in c]
        for a, b in balanced(np.array([len(piece) for piece in pieces]), BATCH_BYTES):
            for kind in (False, True):
                chosen = a + np.flatnonzero(wide[owner[a:b]] == kind)
                texts = [pieces[k] for k in chosen]
                if not texts:
                    continue
                ids = (exact.encode_batch_fast(texts, add_special_tokens=False) if kind
                       else fast.encode_batch(texts, num_threads=1, allowed_special="all"))
                np.add.at(out, owner[chosen], [len(i) for i in ids])
    return out


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text)``.

    Only lengths leave the Arrow function.  A NULL or empty text has 0 bytes and 0 tokens; a
    NULL id stays NULL; repeated rows give repeated results; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            _, at = words.texts_of(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(lengths(column, vocabulary))],
                ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    counted = shared.bounded(narrow).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
