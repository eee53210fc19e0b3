"""BPE encoding and decoding with forced boundaries.

A merge can only join two bytes that stand side by side inside some vocabulary token. Where a word has a pair of bytes
that no token holds, no merge ever crosses it, so the word is cut there, the fragments are encoded on their own and
their ids are put in a row. Fragments repeat far more often than words, so few of them reach the merge loop.

Works on JSON files of the ``tokenizers`` library whose pre-tokenizer never joins text across white space. Null text
counts as empty and has no ids.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterable, Iterator
from operator import add
from struct import pack

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Words and fragments a worker remembers before it starts afresh; bounds its memory to about 120 MB.
REMEMBERED = 200_000
#: White space as Unicode defines it; Python's own split() also cuts at four control characters.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_EXTRA = re.compile("[\x1c-\x1f]")
#: Below this code point no character combines, and letters, digits and lower case are the same in every Unicode version.
_PLAIN_END = "\u0250"
#: The steps of the file before its merges, and their pattern. A file with other steps goes through the library's.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]
#: Byte-level vocabularies write each byte as a visible character: itself if it is one, else the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_VISIBLE))}
#: Characters of text handled at once.
_AT_ONCE = 2_000_000


class ForcedBoundaryEncoder:
    """Encoder of one vocabulary file, one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.pre_tokenizer = steps.normalizer, steps.pre_tokenizer
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        last = {"end_of_word_suffix": self.end} if self.end else {}
        self.last = Tokenizer(BPE(model["vocab"], merges, **last))
        self.inner = Tokenizer(BPE(model["vocab"], merges))
        #: The pattern for plain characters, if the file's own steps are the ones it stands for.
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.plain = regex.compile(_PATTERN) if steps == json.dumps(_STEPS) else None
        self.inside = {t[i : i + 2] for token in model["vocab"] for t in [token.removesuffix(self.end) if self.end else token] for i in range(len(t) - 1)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.always = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.always)
        self.inners: dict[str, bytes] = {}
        self.finals: dict[str, bytes] = {}

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word of byte characters: cut wherever a pair lies in no token."""
        if self.inside.issuperset(map(add, word, word[1:])):
            return [word]
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def words(self, chunk: str) -> list[str]:
        """The pre-tokenizer's words of a stretch, as byte characters."""
        if self.plain and max(chunk) < _PLAIN_END:  # lower() and the pattern agree with the library on these, in any Unicode version
            return [w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in self.plain.findall(chunk.lower())]
        normal = self.normalizer.normalize_str(chunk) if self.normalizer else chunk
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> list[str]:
        """Special tokens and the stretches between white space, in order."""
        if self.splitter is None or "<" not in text:
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.splitter.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split() if not _EXTRA.search(text) else [x for x in _WHITE.split(text) if x]

    def learn(self, chunks: Iterable[str]) -> None:
        """Encode stretches not seen so far, fragment by fragment."""
        whole, cut, inner, last = [], [], set(), set()
        for chunk in chunks:
            plan = [self.cuts(word) for word in self.words(chunk)]
            if len(plan) == 1 and len(plan[0]) == 1:
                whole.append((chunk, plan[0][0]))
                last.add(plan[0][0])
                continue
            cut.append((chunk, plan))
            for parts in plan:
                last.add(parts[-1])
                inner.update(parts[:-1])
        for wanted, known, encoder in ((last, self.finals, self.last), (inner, self.inners, self.inner)):
            new = list(wanted.difference(known))
            for fragment, got in zip(new, encoder.encode_batch_fast(new, add_special_tokens=False), strict=True):
                ids = got.ids
                known[fragment] = pack(f"<{len(ids)}I", *ids)
        self.known.update((chunk, self.finals[f]) for chunk, f in whole)
        for chunk, plan in cut:
            self.known[chunk] = b"".join([b"".join(map(self.inners.__getitem__, parts[:-1])) + self.finals[parts[-1]] for parts in plan])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = dict(self.always)
        if len(self.inners) + len(self.finals) > REMEMBERED:
            self.inners, self.finals = {}, {}
        rows = [self.pieces(text or "") for text in texts]
        gc.disable()  # nothing below makes a cycle, and scans of the growing tables would take half the time
        try:
            self.learn(set().union(*rows).difference(self.known))
        finally:
            gc.enable()
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in rows]



class Decoder:
    """Token texts of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: Iterable[bytes | None]) -> list[str]:
        token = self.tokens.__getitem__
        return [" ".join(map(token, memoryview(packed or b"").cast("I"))) for packed in ids]


_MADE: dict[tuple[type, str], ForcedBoundaryEncoder | Decoder] = {}


def _made(kind: type, path: str):
    """The worker's encoder or decoder of a file; the two run in workers of their own, so each holds only what it needs."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``_AT_ONCE`` bytes of the column each, one row at least."""
    total, at = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + (size or 0) > _AT_ONCE:
            yield batch.slice(at, k - at)
            total, at = 0, k
        total += size or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _added(df: DataFrame, source: str, target: str, kind, make) -> DataFrame:
    """``df`` with a column made from another one, batch by batch, row order and all other columns kept."""
    if target in df.columns:
        df = df.drop(target)
    schema = StructType([*df.schema.fields, StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, source):
                values = make(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, target])

    return df.mapInArrow(run, schema)


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the token ids of ``text`` as packed little-endian unsigned 32-bit integers. Replaces a column of that name."""
    return _added(df, text, ids, BinaryType(), lambda xs: pa.array(_made(ForcedBoundaryEncoder, path).encode(xs), pa.binary()))


def decode_column(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the tokens of packed ``ids``, special ones too, joined as the vocabulary file's library does."""
    return _added(df, ids, decoded, StringType(), lambda xs: pa.array(_made(Decoder, path).decode(xs), pa.string()))


def token_digests(df: DataFrame, path: str) -> DataFrame:
    """Ids count and digests of ids and of the decoded text, per document."""
    coded = decode_column(encode_column(df.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
