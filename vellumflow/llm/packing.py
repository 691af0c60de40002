"""Operator 10, packing token sequences by Karmarkar-Karp multiway differencing.

A document is cut at multiples of the window first: whole windows need no packing. What is left over is a
piece, but for one document in FINE, whose rest is cut in halves again and again: these small pieces let
differencing level the windows out to a few tokens. Pieces are dealt by hash into blocks of bounded size;
in each block as many windows as the tokens need are filled by differencing, and one more is opened until
none exceeds its capacity. Blocks are independent, so nothing grows with the corpus but their number."""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, release_state, worker_state, written
from .differencing import items

WINDOW = 4096
#: The id that ends every document.
END = 2
#: One document in so many has its rest cut finely, and pieces of so few tokens are not cut further.
FINE, LEAST = 16, 4
#: Pieces that one task packs at once.
BLOCK = 2048
#: Words that a worker keeps the ids of in each of two generations, and the longest of them in characters.
CACHED, CACHED_LENGTH = 400_000, 64
#: Bytes of texts that are cut into words at once.
TEXTS = 1 << 21


def _plain_letters() -> str:
    """Lower-case letters, ASCII and others, that no normaliser changes or joins with what stands around them."""
    found = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100), *range(0x430, 0x460))]
    return "".join(c for c in found if c.isalpha() and c.islower() and c.lower() == c and all(unicodedata.normalize(f, c) == c for f in ("NFC", "NFKC")))


class WordIds:
    """Ids of texts under a tokenizer that never joins characters across white space, word by word.

    Ids are those of ``encode(text, add_special_tokens=False)``, as little-endian unsigned 32-bit integers. Texts
    are cut, and their different words told, by Arrow; only these are looked up. A word of plain letters, digits
    and ASCII punctuation is cut as the tokenizer's own pattern cuts it, and its parts go to the vocabulary at
    once; any other goes through the whole tokenizer. ``new`` holds the words met lately, ``old`` those before: a
    word that is asked for again moves up, one that is not is forgotten."""

    def __init__(self, path: str):
        self.tokenizer, self.new, self.old, self.parts = Tokenizer.from_file(path), {}, {}, {}
        letters = _plain_letters()
        # fixed value: the tokenizer's pattern over these characters
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+").findall
        self.plain = re.compile(rf"[{letters}\x21-\x40\x5b-\x60\x7b-\x7e]*").fullmatch
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # letters as the vocabulary spells them; those of ASCII stand for themselves
        self.spelt = {ord(c): "".join(t for t, _ in spell(c)) for c in letters if not c.isascii()}
        self.lookup = self.tokenizer.model.tokenize

    def _word(self, w: str) -> bytes:
        if "<|" in w or not self.plain(w):  # a special token may be spelt in it
            return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        found, parts = b"", self.parts
        for part in self.cut(w):
            ids = parts.get(part)
            if ids is None:
                ids = array("I", [t.id for t in self.lookup(part if part.isascii() else part.translate(self.spelt))]).tobytes()
                if len(part) <= CACHED_LENGTH:
                    parts[part] = ids
            found += ids
        return found

    def words(self, ws: list[str]) -> list[bytes]:
        """The ids of each word."""
        if len(self.new) > CACHED:
            self.new, self.old = {}, self.new
        if len(self.parts) > CACHED:
            self.parts = {}
        new, old = self.new, self.old
        found = list(map(new.get, ws))
        for i, ids in enumerate(found):
            if ids is None:
                w = ws[i]
                ids = old.get(w)
                found[i] = ids = self._word(w) if ids is None else ids
                if len(w) <= CACHED_LENGTH:
                    new[w] = ids
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = texts.fill_null("")
        # special tokens are spelt in lower case, and only so
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(low)
        found, many = cut.flatten().dictionary_encode(), cut.value_lengths().to_numpy()
        del low, cut
        ids = pa.array(self.words(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        del found
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        ends = at[np.concatenate(([0], np.cumsum(many)))].tolist()
        raw = memoryview(ids.buffers()[2] if len(ids) else b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def slices(texts: pa.Array, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of texts each, a row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary, kept between tasks."""
    return worker_state(f"words {path}", lambda: WordIds(path))


def cuts(tokens: int, fine: bool, window: int = WINDOW) -> list[int]:
    """Lengths of a document's pieces, in order."""
    found, rest = [window] * (tokens // window), tokens % window
    while fine and rest > LEAST:
        found.append(rest - rest // 2)
        rest //= 2
    return found + [rest] if rest else found


def pieces(docs: pa.RecordBatch, encode, window: int = WINDOW) -> pa.RecordBatch:
    """The pieces of rows of (id, text, fine), whose ids ``encode`` tells."""
    rows, end = [], END.to_bytes(4, "little")
    for doc, ids, fine in zip(docs.column(0).to_pylist(), encode(docs.column(1)), docs.column(2).to_pylist()):
        ids += end
        at, n = 0, len(ids) // 4
        for length in cuts(n, fine, window):
            rows.append((doc, at, length, ids[4 * at : 4 * (at + length)], n))
            at += length
    kinds = (docs.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "start", "length", "ids", "doc_tokens"])


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, start, length, ids, doc_tokens): the pieces of every row's tokens and the end id after them.

    ids are little-endian unsigned 32-bit integers. A null or empty text has the end id alone. Rows that
    repeat are cut alike, each for itself; other columns are not read."""

    def run(batches):
        encode = word_ids(tokenizer).encode
        for b in batches:
            for i, j in slices(b.column(1)):
                yield pieces(b.slice(i, j - i), encode, window)
                give_back()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    fine = F.pmod(F.xxhash64(id_col, text_col), F.lit(FINE)) == 0
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fine.alias("fine")).mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")


def windows(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The window of each piece; a piece as long as a window has one of its own."""
    at = np.empty(len(lengths), np.int64)
    full = lengths == window
    at[full] = np.arange(full.sum())
    rest = lengths[~full]
    n = math.ceil(rest.sum() / window)
    while rest.size:
        put = items(rest, n)
        if np.bincount(put, rest).max() <= window:
            at[~full] = full.sum() + put
            break
        n += 1
    return at


def placed(t: pa.Table, window: int = WINDOW) -> pa.Table:
    """A block's pieces with their sequences and offsets. The worker gives up what it cut texts with."""
    release_state()
    t = t.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
    length = t["length"].to_numpy()
    sequence = windows(length, window)
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(length[order])
    first = np.concatenate(([0], np.nonzero(np.diff(sequence[order]))[0] + 1))
    base = np.repeat((ends - length[order])[first], np.diff(np.concatenate((first, [len(order)]))))
    offset = np.empty(len(order), np.int64)
    offset[order] = ends - length[order] - base
    block = t["block"][0].as_py()
    return t.drop_columns(["block"]).append_column("sequence_id", pa.array((block << 32) + sequence)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset: the sequence each goes to, and its place there.

    ``pieces`` has id, start and length (1 to window) and whatever other columns. Sequences are filled
    without gaps; sequence ids are distinct but not gapless. Whole windows are sequences as they are, with
    negative ids, and stay where they lie. Pieces with null ids and repeated pieces are
    packed like others: a number of its own spreads each row over the blocks. An empty table gives an empty table."""
    pieces = written(pieces.withColumn("block", F.xxhash64("id", "start", F.monotonically_increasing_id())), "pieces")
    whole, pieces = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    n = max(1, math.ceil(pieces.count() / BLOCK))

    def run(t: pa.Table) -> pa.Table:
        return placed(t, window)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("block").schema)
    packed = pieces.withColumn("block", F.pmod("block", F.lit(n))).groupBy("block").applyInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
    alone = whole.drop("block").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.union(alone)
