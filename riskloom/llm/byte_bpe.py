"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Each token's bytes become a piece of printable characters (one per byte), scored by its negative rank, with identity
normalisation and no added prefix; sentencepiece then merges the best-scored pair first, leftmost on ties, which is
the rank order.  A pre-token that is itself a token is that token.  Pre-tokens are matched by the tokenizer's
pattern; decoding maps ids back to bytes.

Ids leave as packed little-endian unsigned 32-bit integers, the layout of training files; ``unpack_ids`` gives an
array column.  The rank file is a fixed asset of about a megabyte, read on the driver and broadcast.

Defined cases.  A null text is empty: no ids, empty bytes.  Texts of any length are encoded whole.  Ids outside the
vocabulary fail when decoded.  Extra columns pass through unless an output column has their name.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from riskloom.llm import support
from riskloom.llm.textbytes import slices

VOCABULARY = os.environ.get("RISKLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# fixed value: the pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_TOKENS = 1 << 17
OWN = ("n_tokens", "token_ids", "decoded")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must be 0 .. n-1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: piece i is token i, scored -i; the unknown piece comes last."""
    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join([letters[b] for b in token]), score=-float(rank),
                         type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type = pb.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    trainer.byte_fallback = False
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(name, every):
            classes[points[run.start():run.end()]] = kind
    return classes


def coder_data(path: str) -> dict:
    """What a worker needs to build its coder: about 3 MB, independent of the input."""
    tokens = read_ranks(path)
    return {"tokens": tokens, "classes": character_classes(), "model": sentencepiece_model(tokens)}


class ByteBpe:
    """Encoder and decoder."""

    def __init__(self, data: dict):
        self.tokens, self.classes = data["tokens"], data["classes"]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data["model"])
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {token: i for i, token in enumerate(self.tokens)}
        self.known: dict[bytes, bytes] = {}

    def pretokens(self, text: str) -> np.ndarray:
        """Where the matches of ``PATTERN`` begin, as character positions.

        The matches cover the text, so their starts follow from the classes of neighbouring characters: a run of
        letters, of numbers or of other characters takes one blank before it; white space before such a run keeps
        its last character apart; an apostrophe that begins a match takes a short ending after it.
        """
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(points)
        kind = self.classes[points]
        begins = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        # the last character of white space before something else begins a match; a blank takes the run along
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
        begins[last] = True
        blank = points[last] == 0x20
        begins[last[blank] + 1] = False
        quotes = np.flatnonzero(points[:-1] == 0x27)
        for at in quotes[begins[quotes]].tolist():
            two = text[at + 1:at + 3]
            size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size and at + 1 + size < n:
                begins[at + 1 + size] = True
            if size:
                begins[at + 1] = False
        return np.flatnonzero(begins)

    def learn(self, pretokens: set[bytes]) -> None:
        """Encodes pre-tokens that are not in the cache, all in one call."""
        new, mapped = [], []
        for raw in pretokens:
            rank = self.whole.get(raw)
            if rank is not None:
                self.known[raw] = rank.to_bytes(4, "little")
            else:
                new.append(raw)
                mapped.append(raw.decode("latin-1").translate(self.letters))
        if new:
            found = self.processor.encode(mapped, num_threads=1)
            self.known.update(zip(new, [np.array(ids, "<u4").tobytes() for ids in found]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        words = []
        for text in texts:
            raw, starts = text.encode(), self.pretokens(text) if text else np.zeros(0, np.int64)
            if len(raw) != len(text):
                # character positions to byte positions: continuation bytes do not begin a character
                starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts]
            cuts = [*starts.tolist(), len(raw)]
            words.append([raw[a:b] for a, b in zip(cuts, cuts[1:])])
        missing = set().union(*words).difference(self.known)
        if len(self.known) + len(missing) > CACHED_TOKENS:
            self.known.clear()
            missing = set().union(*words)
        self.learn(missing)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def shared_coder(df: DataFrame, path: str):
    """A broadcast from which ``coder_of`` takes the worker's coder."""
    return df.sparkSession.sparkContext.broadcast(coder_data(path))


def coder_of(shared) -> ByteBpe:
    """One coder per worker process: its cache of pre-tokens serves all of its tasks."""
    data = shared.value
    if "coder" not in data:
        data["coder"] = ByteBpe(data)
    return data["coder"]


def _with_rest(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(support.packed(docs, text).alias("rest"), support.col(text).alias("text"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", decoded: bool = False,
           keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids``; with ``decoded`` also the bytes that the ids stand for.

    Without ``keep_text`` the text stays in the task, which halves what comes back.
    """
    shared = shared_coder(docs, vocabulary)
    own, kept = OWN if decoded else OWN[:2], ["text"] if keep_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = coder.encode_batch([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("rest"), *([part.column("text")] if keep_text else []),
                           pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["rest", *kept, *own])

    source = _with_rest(docs, text)
    kind = source.schema["rest"].dataType.simpleString()
    found = source.mapInArrow(run, f"rest {kind}, " + "text string, " * keep_text + "n_tokens long, token_ids binary"
                              + ", decoded binary" * decoded)
    named = found.withColumnRenamed("text", text) if keep_text and text != "text" else found
    return support.unpacked(named, "rest", *([text] if keep_text else []), *own)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the packed ids; null ids give empty bytes."""
    shared = shared_coder(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            texts = [coder.decode(i.as_py() or b"") for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())],
                                             names=["row", "decoded"])

    source = encoded.select(support.packed(encoded).alias("row"), support.col(ids).alias("ids"))
    kind = source.schema["row"].dataType.simpleString()
    return support.unpacked(source.mapInArrow(run, f"row {kind}, decoded binary"), "row", "decoded")


def unpack_ids(ids: str = "token_ids"):
    """An ``array<long>`` column of packed ids."""
    return F.expr(f"""case when length({ids}) >= 4 then transform(sequence(1, length({ids}) div 4),
        i -> cast(conv(concat(hex(substring({ids}, 4 * i, 1)), hex(substring({ids}, 4 * i - 1, 1)),
                              hex(substring({ids}, 4 * i - 2, 1)), hex(substring({ids}, 4 * i - 3, 1))), 16, 10)
                  as long)) else array() end""")


def digests(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the hashes of the packed ids and of the decoded bytes."""
    return encoded.select(support.col(doc_id).alias("doc_id"), "n_tokens",
                          F.sha2("token_ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
