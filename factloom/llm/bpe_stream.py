"""BPE as a streaming transducer with bounded lookahead, and the decoder as an incremental state machine.

Two facts make streaming exact. A token boundary of the whole run splits it into two independent runs, as no merge
crosses it. And whether a symbol keeps its right edge depends on a bounded stretch to its right: a later symbol can only
take it by a merge of a lower rank than the one that it waits for, that symbol's own making by a still lower one, and so
on. ``Merges.lookahead`` is the longest such chain over the merge list. The transducer therefore holds one buffer,
merges it, and emits every token that ends at least ``lookahead`` symbols before the buffer's end.

A text flows through in blocks that end before white space. Every pre-token goes through the transducer and every id through the
decoder as soon as it is stable; both are back at their start when a pre-token ends, so what they emitted for a short one is
remembered and serves again. Digests are fed piece by piece: neither the ids nor the decoded text of a document are ever held whole,
unless their columns are asked for.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Symbols that the transducer gathers beyond its lookahead before it merges.
BLOCK = 4096
#: Characters of a text that are split at once; a block goes on to the next white space.
CHARS, SPACE = 1 << 15, re.compile(r"[ \t\n\r]")
#: Pre-tokens, shorter than ``SHORT`` characters, of which a task keeps what was emitted; the memory is emptied when it is full.
REMEMBERED, SHORT = 300_000, 64
#: Characters whose class no Unicode version in use disputes; a text with others is normalised and split by the tokenizers library.
ODD = re.compile(r"[^\t\n\r -~\xa1-ɏͰ-ԯ‐-‧₠-₿぀-ヿ一-鿿가-힣]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge list of a tokenizer file, as ranks by pairs of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        chars = byte_alphabet()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        self.at_end = dict(zip(self.inner, self.last))
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for a, b in pairs:
            self.rank[vocab[a], vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.lookahead = self._lookahead(vocab)

    def _lookahead(self, vocab: dict[str, int]) -> int:
        size = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in vocab.items()}
        taken: dict[int, int] = {}  # by a symbol: the longest chain by which a merge so far takes it from the right
        spine: dict[int, int] = {}  # by a symbol: the same for its right-hand parts until each was merged in
        for (left, right), new in zip(self.rank, self.made):
            chain = size[right] + max(taken.get(right, 0), spine.get(right, 0))
            kept = max(taken.get(right, 0), spine.get(right, 0))
            spine[new] = max(spine.get(new, 0), kept)
            taken[left] = max(taken.get(left, 0), chain)
        return max([0, *taken.values(), *spine.values()])

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge pairs by rank, then from the left, until none is left."""
        rank, made, none = self.rank, self.made, len(self.made)
        ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            new, at, start = made[low], 0, 0
            while True:
                try:
                    at = ranks.index(low, start)
                except ValueError:
                    break
                symbols[at : at + 2] = [new]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank.get((symbols[at - 1], new), none)
                if at < len(ranks):
                    ranks[at] = rank.get((new, symbols[at + 1]), none)
                start = at
                if at < len(ranks) and ranks[at] < low or at and ranks[at - 1] < low:
                    break
        return symbols


class Transducer:
    """Feeds on bytes of one pre-token at a time; emits ids as soon as they are stable; holds at most ``block`` + lookahead symbols."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.limit, self.held = merges, block + merges.lookahead, []

    def feed(self, data: bytes):
        inner = self.merges.inner
        for b in data:
            self.held.append(inner[b])
            if len(self.held) > self.limit:
                yield from self._stable()

    def _stable(self):
        tokens = self.merges.merge(self.held.copy())
        width, at, edge = self.widths, 0, len(self.held) - self.merges.lookahead - 1
        for t in tokens:
            if at + width(t) > edge:
                break
            at += width(t)
            yield t
        self.held = self.held[at:]

    def widths(self, token: int) -> int:
        return len(self.merges.text_of[token])

    def end(self):
        """The pre-token's end: its last symbol takes the end-of-word mark, and everything held is stable."""
        if self.held:
            m = self.merges
            self.held[-1] = m.at_end[self.held[-1]]
            yield from m.merge(self.held)
            self.held = []


class Decoder:
    """Ids to text, one at a time. For byte-level files bytes wait until they form a character; else tokens are joined by a space."""

    def __init__(self, merges: Merges):
        self.text_of, self.byte_level, self.special = merges.text_of, merges.byte_level, set(merges.special.values())
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.reset()

    def reset(self):
        self.utf8, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def step(self, token: int) -> str:
        if self.byte_level:
            if token in self.special:
                return self.utf8.decode(b"", True) + self.text_of[token]
            return self.utf8.decode(bytes(self.byte_of[c] for c in self.text_of[token]))
        before, self.first = "" if self.first else " ", False
        return before + self.text_of[token]

    def decode(self, decimals: str) -> str:
        self.reset()
        return "".join([self.step(int(i)) for i in decimals.split()]) + self.utf8.decode(b"", True)


class Remembered(dict):
    """What the transducer and the decoder emit for a short pre-token: (number of ids, ids, their text)."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str):
        parts = list(self.codec.through(word))
        out = sum(n for n, _, _ in parts), " ".join([ids for _, ids, _ in parts]), "".join([text for _, _, text in parts])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


class Codec:
    """Whole texts to ids and back, as the tokenizer file says: special strings, NFC, white space, lower case, words, merges."""

    def __init__(self, path: str, block: int = BLOCK):
        self.merges = Merges(path)
        self.transducer, self.decoder = Transducer(self.merges, block), Decoder(self.merges)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        exact = Tokenizer.from_file(path)
        self.normal = exact.normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")") if self.merges.special else None
        self.remembered = Remembered(self)

    def through(self, word: str):
        """(1, id, its text) of a pre-token's tokens as they become stable; the first text has no space before it."""
        step = self.decoder.step
        self.decoder.reset()
        for at in range(0, len(word), CHARS):
            for i in self.transducer.feed(word[at : at + CHARS].encode()):
                yield 1, str(i), step(i)
        for i in self.transducer.end():
            yield 1, str(i), step(i)

    def pieces(self, text: str | None):
        """Lists of (number of ids, ids, their text), in order: of each list, and of the lists, the ids and the texts are joined by a space."""
        text, at = text or "", 0
        while at < len(text):
            found = SPACE.search(text, at + CHARS)
            end = found.start() if found else len(text)
            block, at = text[at:end], end
            for piece in self.marks.split(block) if self.marks else [block]:
                if piece in self.merges.special:
                    yield [(1, str(self.merges.special[piece]), piece)]
                elif piece:
                    yield from self._words(piece)

    def _words(self, piece: str):
        if ODD.search(piece):
            words = [w for w, _ in self.split(self.normal(piece))]
        else:
            plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
            words = self.words.findall(plain.replace("Σ", "σ").lower())
        if len(max(words, key=len, default="")) < SHORT:
            if words:
                yield list(map(self.remembered.__getitem__, words))
            return
        for word in words:
            if len(word) < SHORT:
                yield [self.remembered[word]]
            else:
                for n, ids, decoded in self.through(word):
                    yield [(n, ids, decoded.removeprefix(" "))]

    def encode(self, text: str | None) -> str:
        """The ids as decimals with one space between; the empty string for a null or empty text."""
        return " ".join([ids for part in self.pieces(text) for _, ids, _ in part])


class Outputs:
    """Takes in a text's pieces; counts, digests and, with ``contents``, keeps them."""

    def __init__(self, contents: bool):
        self.n, self.ids, self.text, self.kept = 0, sha256(), sha256(), ([], []) if contents else None

    def take(self, part: list[tuple[int, str, str]]):
        counts, ids, texts = zip(*part)
        before = " " if self.n else ""
        ids, texts = before + " ".join(ids), before + " ".join(texts)
        self.n += sum(counts)
        self.ids.update(ids.encode())
        self.text.update(texts.encode())
        if self.kept:
            self.kept[0].append(ids)
            self.kept[1].append(texts)

    def row(self) -> tuple:
        return (self.n, self.ids.hexdigest(), self.text.hexdigest(), *map("".join, self.kept or ()))


@lru_cache(2)
def codec(vocabulary: str) -> Codec:
    import public_tokenizers

    return Codec(public_tokenizers.path(f"{vocabulary}.json"))


def transcode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k", contents: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``contents``, ``ids`` (decimals) and ``decoded``.

    A null or empty text has no ids and decodes to the empty string. Every row of ``docs`` gives one row, rows that repeat an id as well; an empty table gives
    none. Other columns are not read. Beside the batch of texts itself a task's memory is one block, the transducer's buffer and a bounded memory of
    short pre-tokens (with ``contents``, also the ids and texts of the rows that go out together).
    """

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64 if contents else 1024):
                part = batch.slice(at, 64 if contents else 1024)
                rows = []
                for text in part.column(1):
                    out = Outputs(contents)
                    for piece in own.pieces(text.as_py()):
                        out.take(piece)
                    rows.append(out.row())
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.string()] * 4]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if contents else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if contents else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op3_bpe(spark, sf_dir):
    return transcode(spark.read.parquet(f"{sf_dir}/documents.parquet"), contents=False)
