"""SentencePiece models through the tokenizers library.

The model's protobuf is parsed here; from it come the normaliser, the metaspace
marker, scores (unigram) or merges (BPE) and the byte fallback of an equivalent
``tokenizers`` tokenizer, which encodes batches on several threads. Parity with
the sentencepiece library is verified for every text, by its words where a text's
ids are those of its words; where the two differ, sentencepiece's ids are taken.
Every text is decoded again.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Where the public vocabularies are; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the format: model types and kinds of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested ones stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, kind)] and the settings that encoding needs, with the format's defaults."""
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            out |= {"model_type": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
        elif number == 3:
            norm = dict(fields(value))
            out |= {"charsmap": norm.get(2, b"")} | {k: bool(norm.get(n, 1)) for n, k in ((3, "add_dummy_prefix"), (4, "remove_extra_whitespaces"), (5, "escape_whitespaces"))}
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that form a piece, best score first.

    Of equal scores the longer left piece comes first: SentencePiece then goes by
    position, so a run of markers (all of one score) grows from its left end.
    """
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = [(-s, -i, rank[p[:i]], p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def unmatched(pieces: list[tuple[str, float, int]]) -> list[str]:
    """Names for the pieces under which only those occur in a text that may: control, byte and
    unused pieces stand for no text, so they get a name with a noncharacter."""
    return [p if kind in (NORMAL, USER) else f"\U0010ffff{i}" for i, (p, _, kind) in enumerate(pieces)]


def build(model: str = MODEL):
    """The tokenizers.Tokenizer equivalent to a SentencePiece model file.

    User-defined pieces are matched before all others. A unigram model's byte pieces
    aren't known to the tokenizer: it gives the unknown piece, which ``Codec`` turns into bytes.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    with open(model, "rb") as f:
        m = parse_model(f.read())
    pieces = m["pieces"]
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if m["model_type"] == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    elif m["model_type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, (_, s, _) in zip(unmatched(pieces), pieces, strict=True)], unk_id=unknown)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(core)
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER])
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["remove_extra_whitespaces"]:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["add_dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if m["escape_whitespaces"]:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m["add_dummy_prefix"] else []))
    return t


#: Twice so many words take some 50 MB of a worker.
WORD_CACHE = 100_000
#: Unseen words are encoded together, so many characters at a time.
JOINED = 2048


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids as one array, and where each list ends in it."""
    return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))


def arrays(ids: list) -> list[np.ndarray]:
    return [np.asarray(x, np.int32) for x in ids]


def cut_at(words: list[str], ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """Each word with its ids, which end there, as packed 32-bit integers."""
    data, ends = ids.tobytes(), (4 * ends).tolist()
    return zip(words, [data[s:e] for s, e in zip([0, *ends], ends, strict=False)], strict=True)


class Codec:
    """Encodes and decodes lists of texts with the tokenizer of ``build``.

    If no piece of the model goes on into a marker, a text's ids are those of its
    words (a run of markers and what follows it) one after the other. Words met
    lately are then remembered, twice ``WORD_CACHE`` of them at most; the unseen
    words of all texts are encoded together as one multithreaded batch.

    judge, a SentencePieceProcessor of the same model, encodes each unseen word
    once (each text, if ids don't go by words or the model normalises more than
    spaces); its ids are taken where they differ.
    """

    def __init__(self, model: str, threads: int = 2, judge=None):
        self.judge, self.threads = judge, threads
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer = build(model)
        with open(model, "rb") as f:
            m = parse_model(f.read())
        pieces = [p for p, _, _ in m["pieces"]]
        self.by_word = m["byte_fallback"] and all(MARK not in p.lstrip(MARK) for p in pieces)
        self.prefix = m["add_dummy_prefix"]
        self.spaces_only = m["escape_whitespaces"] and not m["charsmap"] and not m["remove_extra_whitespaces"]
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        kinds = [kind for _, _, kind in m["pieces"]]
        self.unknown = kinds.index(UNKNOWN)
        # with byte fallback a unigram model's unknown text is spelt in bytes
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m["pieces"]) if kind == BYTE} if m["byte_fallback"] and m["model_type"] == UNIGRAM else {}
        # of each id the bytes of the normalised text it stands for
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, _, kind in m["pieces"]]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.pieces = pa.array(self.bytes, pa.large_binary())
        # ids of words as packed 32-bit integers, a fourth of what lists take
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words for which the tokenizer and the judge differ
        self.words_judged = judge is not None and self.by_word and self.spaces_only

    def normalized(self, text: str) -> str:
        if not self.spaces_only:
            return self.normalizer.normalize_str(text)
        return (MARK * self.prefix + text.replace(" ", MARK)) if text else ""

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.verified(texts)[0]

    def verified(self, texts: list[str]) -> tuple[list[list[int]], list[bool | None]]:
        """The ids of each text, and whether the tokenizer's own are those of the judge (None without one)."""
        ids, same = self.checked(texts)
        return [x.tolist() for x in ids], same

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool | None]]:
        """``verified``, with ids in arrays."""
        ids, odd = self.tokenized(texts)
        if self.judge is None:
            return ids, [None] * len(texts)
        if self.words_judged:
            return ids, [not x for x in odd]
        theirs = arrays(self.judge.encode(texts, num_threads=self.threads) if texts else [])
        return theirs, [np.array_equal(a, b) for a, b in zip(ids, theirs, strict=True)]

    def tokenized(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether words of it are among the odd ones."""
        plain = [self.normalized(t) for t in texts]
        if not self.by_word:
            return arrays(self.plain_ids(plain)), [False] * len(texts)
        split = [WORD.findall(t) for t in plain]
        # distinct words are numbered, and looked up once
        numbers: dict[str, int] = defaultdict(count().__next__)
        order = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64)
        new, old = self.new, self.old
        unseen = [w for w in numbers if w not in new]
        for w in unseen:
            if w in old:
                new[w] = old[w]
        self.learn([w for w in unseen if w not in old])
        each = list(map(new.__getitem__, numbers))
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        n = sizes[order]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - n), n) + np.arange(n.sum())
        words = np.cumsum([len(x) for x in split], dtype=np.int64)
        ids = np.split(np.frombuffer(b"".join(each), np.int32)[at], np.concatenate([[0], ends])[words[:-1]]) if texts else []
        odd = [bool(self.odd) and not self.odd.isdisjoint(words) for words in split]
        if len(new) > WORD_CACHE:
            self.old, self.new = new, {}
            self.odd &= new.keys()
        return ids, odd

    def plain_ids(self, plain: list[str]) -> list[list[int]]:
        """The tokenizer's ids of normalised texts, as one multithreaded batch."""
        if not self.byte_ids:
            return [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        out = []
        for t, e in zip(plain, self.tokenizer.encode_batch(plain, add_special_tokens=False), strict=True):
            ids = e.ids
            if self.unknown in ids:
                spelt = ([i] if i != self.unknown else [self.byte_ids[b] for b in t[s:n].encode("utf-8", "surrogatepass")] for i, (s, n) in zip(ids, e.offsets, strict=True))
                ids = [i for x in spelt for i in x]
            out.append(ids)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words joined to strings, and cut the ids where a word's bytes end."""
        groups: list[list[str]] = [[]]
        held = 0
        # markers alone would run on into the next word, and a word without one into that before it
        alone = [w for w in words if w[-1] == MARK or w[0] != MARK]
        for w in set(words).difference(alone):
            if held + len(w) > JOINED and groups[-1]:
                groups.append([])
                held = 0
            groups[-1].append(w)
            held += len(w)
        groups = [g for g in groups if g] + [[w] for w in alone]
        listed = [w for g in groups for w in g]
        joined = ["".join(g) for g in groups]
        ids, _ = flat(self.plain_ids(joined))
        ends = np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in listed), np.int64, len(listed)))
        spelt = np.cumsum(self.sizes[ids])
        at = np.searchsorted(spelt, ends) + 1  # behind the id that ends where the word does
        fits = np.array_equal(spelt[np.minimum(at, len(ids)) - 1] if len(ids) else spelt, ends)
        if not fits:  # ids that run over a word's end
            ids, at = flat(self.plain_ids(listed))
        self.new.update(cut_at(listed, ids, at))
        # where the judge's ids of all joined words are these, so are those of each word
        if self.words_judged and not (fits and np.array_equal(flat(self.judged(joined))[0], ids)):
            right = dict(cut_at(listed, *flat(self.judged(listed))))
            self.odd.update(w for w in listed if right[w] != self.new[w])
            self.new.update(right)

    def judged(self, words: list[str]) -> list[list[int]]:
        """The judge's ids of words as they stand inside a text."""
        if not words:
            return []
        # the judge puts the first marker there itself, but not before an empty text
        theirs = self.judge.encode([w[self.prefix :].replace(MARK, " ") for w in words], num_threads=self.threads)
        if self.prefix:
            before = len(self.judge.encode("a"))
            theirs = [self.judge.encode("a ")[before:] if w == MARK else x for w, x in zip(words, theirs, strict=True)]
        return theirs

    def decode(self, ids: list) -> list[str]:
        out = []
        every = np.concatenate([np.zeros(0, np.int32), *arrays(ids)])
        data = self.pieces.take(pa.array(every)).buffers()[2] if len(every) else None
        data = memoryview(data) if data else b""
        ends = np.concatenate([[0], np.cumsum(self.sizes[every])])[np.cumsum([len(x) for x in ids], dtype=np.int64)].tolist()
        for s, e in zip([0, *ends], ends, strict=False):
            text = str(data[s:e], "utf-8", "replace").replace(MARK, " ")
            out.append(text.removeprefix(" ") if self.prefix else text)
        return out


@lru_cache(maxsize=1)
def kept_codec(model: str, threads: int, digest: str) -> Codec:
    """A worker's codec of a model file, by its content, with its judge: made once, for all tasks that the worker runs."""
    import sentencepiece

    return Codec(model, threads, sentencepiece.SentencePieceProcessor(model_file=model))


def codec_of(model: str, threads: int) -> Codec:
    with open(model, "rb") as f:
        return kept_codec(model, threads, hashlib.sha256(f.read()).hexdigest())


WORD = re.compile(f"^[^{MARK}]+|{MARK}+[^{MARK}]*")


SCHEMA = pa.schema([("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("tokens_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])


def tokenize(docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL, threads: int = 2, verify_every: int = 50, ids: bool = True) -> DataFrame:
    """``keep`` columns, tokens (unless ids is false), n_tokens, tokens_sha256 (of the ids as
    little-endian 32-bit integers), decoded_sha256, round_trip and parity for every row.

    A null text has nulls there; an empty one has no tokens. round_trip: the
    decoded text is the text. parity: whether the tokenizer gave the ids of the
    sentencepiece library, which are returned in any case. It is verified for every
    text by ``Codec``, and once more on the whole for about one text in ``verify_every``
    (by its checksum, so that copies are treated alike).
    """
    schema = pa.schema([f for f in SCHEMA if ids or f.name != "tokens"])

    def make():
        codec = codec_of(model, threads)

        def run(texts: list) -> list:
            out: list[list] = [[] for _ in SCHEMA]
            coded, same = codec.checked([t or "" for t in texts])
            if codec.words_judged:
                for n, t in enumerate(texts):
                    if t and zlib.crc32(t.encode("utf-8", "surrogatepass")) % verify_every == 0 and (whole := codec.judge.encode(t)) != coded[n].tolist():
                        coded[n], same[n] = np.array(whole, np.int32), False
            for t, i, ok, back in zip(texts, coded, same, codec.decode(coded), strict=True):
                if t is None:
                    row = [None] * len(SCHEMA)
                else:
                    row = [i, len(i), hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t, ok]
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return out if ids else out[1:]

        return run

    return map_texts(docs, keep, text, schema, make)
