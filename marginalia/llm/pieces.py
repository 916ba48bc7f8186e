"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf gives pieces, scores, piece types and normaliser options.
From them a ``tokenizers`` pipeline is rebuilt: the normaliser, the metaspace
marker, a unigram model with its scores and byte fallback (or, for models of
type BPE, the merges implied by piece ranks). Texts are cut where no piece can
reach across, segments are encoded in multithreaded batches, once per different
segment of a worker's cache, and ids are put together with Arrow. Parity with
the sentencepiece library is verified when a model is loaded, on a fixed probe,
and every row carries the result of an exact round trip.

Nulls and empty texts encode to no ids. Ids outside the vocabulary are an error
in ``decode``. Nothing is trained here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches, ship_package, table, text_of

MARK = "▁"
CACHE_SEGMENTS = 400_000
CHUNK_ROWS = 256
PROBE = ["", " ", "a", "Hello  wörld", " lead and trail ", "tabs\tand\nlines\n\n", "naïve café 漢字 ☃ \U0001f600", "a▁b ▁ c", "x" * 60, "1234567890 3.14", "é ​ ﬁ", "The quick brown fox."]

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


class Codec:
    """One model, loaded in the process that uses it."""

    def __init__(self, path: str, threads: int = 1):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(max(1, threads)))
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        proto.ParseFromString(raw)
        self.proto = proto
        self.pieces = [p.piece for p in proto.pieces]
        self.vocabulary = {p: i for i, p in enumerate(self.pieces)}
        self.kinds = [p.type for p in proto.pieces]
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.tokenizer = self._build()
        self.cuts = self._can_cut()
        self._cache: dict[str, list[int]] = {}
        self._table()
        self.processor = SentencePieceProcessor(model_proto=raw)
        wrong = [x for x in PROBE if self.encode([x])[0] != self.processor.encode(x) or self.decode(self.encode([x]))[0] != self.processor.decode(self.processor.encode(x))]
        if wrong:
            raise ValueError(f"tokenizers and sentencepiece disagree on {wrong[:3]!r}")

    def _build(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        spec, trainer = self.proto.normalizer_spec, self.proto.trainer_spec
        if trainer.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix are not supported")
        unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else None
        if trainer.model_type == trainer.UNIGRAM:
            model = models.Unigram([(p.piece, p.score) for p in self.proto.pieces], unknown, trainer.byte_fallback)
        elif trainer.model_type == trainer.BPE:
            model = models.BPE(
                vocab=self.vocabulary, merges=self._merges(), unk_token=self.pieces[unknown] if unknown is not None else None, fuse_unk=True, byte_fallback=trainer.byte_fallback
            )
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        built = Tokenizer(model)
        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        steps.append(normalizers.Replace(" ", MARK))
        built.normalizer = normalizers.Sequence(steps)
        built.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        # User-defined pieces always stay whole.
        own = [AddedToken(p, normalized=True, special=False) for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED]
        if own:
            built.add_tokens(own)
        return built

    def _merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces; the better piece first, then the lower ranks."""
        rank, found = self.vocabulary, []
        for p in self.proto.pieces:
            if p.type in (NORMAL, USER_DEFINED):
                s = p.piece
                parts = [(s[:i], s[i:]) for i in range(1, len(s)) if s[:i] in rank and s[i:] in rank]
                found += [(-p.score, rank[a], rank[b], a, b) for a, b in parts]
        found.sort(key=lambda x: x[0])
        return [(a, b) for *_, a, b in found]

    def _can_cut(self) -> bool:
        """Whether texts may be cut before each run of spaces: no piece has the marker after another character, and nothing is rewritten."""
        spec = self.proto.normalizer_spec
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        return plain and USER_DEFINED not in self.kinds and all(MARK not in p.lstrip(MARK) for p in self.pieces)

    def _table(self) -> None:
        """Bytes of each piece, for decoding by lookup."""
        self.exact = True
        values = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            if k == BYTE:
                values.append(bytes([int(p[3:5], 16)]))
            elif k in (UNKNOWN, CONTROL):
                values.append(b"")
            else:
                values.append(p.replace(MARK, " ").encode())
        self.table = pa.array(values, pa.large_binary())
        self.special = np.array([k in (UNKNOWN, CONTROL) for k in self.kinds])

    def _segments(self, text: str) -> list[str]:
        """Pieces of the text that are encoded apart: runs of spaces with the characters after them."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.dummy_prefix:
            marked = MARK + marked
        if not self.cuts:
            return [marked]
        parts = marked.split(MARK)
        if "" not in parts[1:]:
            return [MARK + p for p in parts[1:]] if not parts[0] else [parts[0], *[MARK + p for p in parts[1:]]]
        out, lead = [], ""
        for i, p in enumerate(parts):
            lead += MARK if i else ""
            if p:
                out.append(lead + p)
                lead = ""
        return out + ([lead] if lead else [])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, equal to those of sentencepiece. Each different segment is encoded once per cache."""
        if not self.cuts:
            prefix = MARK if self.dummy_prefix else ""
            spec = self.proto.normalizer_spec

            def whole(t: str) -> str:
                t = t.strip(" ") if spec.remove_extra_whitespaces else t
                return prefix + t if t else ""

            return [e.ids for e in self.tokenizer.encode_batch_fast([whole(t) for t in texts], add_special_tokens=False)]
        split = [self._segments(t) for t in texts]
        cache = self._cache
        if len(cache) > CACHE_SEGMENTS:
            cache.clear()
        fresh = list({s for parts in split for s in parts if s not in cache})
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[s] = e.ids
        get = cache.__getitem__
        return [list(chain.from_iterable(map(get, parts))) for parts in split]

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of rows of ids; bytes that are no UTF-8 and special pieces take the library's decoder."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
        return self.decode_flat(ids, np.concatenate([[0], np.cumsum(lengths)]))

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("id outside the vocabulary")
        out: list[str] = []
        taken = self.table.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
        raw = taken.buffers()[2].to_pybytes() if len(ids) else b""
        odd = self.special[ids] if len(ids) else np.zeros(0, bool)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            try:
                if odd[a:b].any():
                    raise UnicodeDecodeError("utf-8", b"", 0, 1, "special piece")
                text = raw[ends[a] : ends[b]].decode()
                out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out.append(self.processor.decode(ids[a:b].tolist()))
        return out


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = 1) -> Codec:
    """The codec of this process for a model file; files reach executors with ``addFile`` or an installed package."""
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


def default_model() -> str:
    """The public 32k model of the installed tokenizer package; the path is a parameter everywhere."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _resolver(spark: SparkSession, model: str):
    """Ship the model with the job and return a function that finds it on any executor."""
    from pyspark import SparkFiles

    name = os.path.basename(model)
    if name not in _shipped_models.setdefault(spark.sparkContext.applicationId, {}):
        spark.sparkContext.addFile(model)
        _shipped_models[spark.sparkContext.applicationId][name] = model
    if _shipped_models[spark.sparkContext.applicationId][name] != model:
        raise ValueError(f"two models are called {name}")
    return lambda: SparkFiles.get(name)


_shipped_models: dict[str, dict[str, str]] = {}


def encode(docs: DataFrame, model: str | None = None, threads: int | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with n_tokens, ids and round_trip (the ids decode to exactly this text).

    ``threads`` is the number of cores of a task (``spark.task.cpus``) by default.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    model = model or default_model()
    find = _resolver(spark, model)
    threads = threads or int(spark.conf.get("spark.task.cpus", "1"))
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in ("n_tokens", "ids", "round_trip")]
    narrow = docs.select(*[F.col(c) for c in keep], text_of(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(find(), threads)
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(lo, CHUNK_ROWS)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                rows = tool.encode(texts)
                lengths = np.fromiter(map(len, rows), np.int64, len(rows))
                ids = np.fromiter(chain.from_iterable(rows), np.int32, int(lengths.sum()))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                back = tool.decode_flat(ids, offsets)
                same = [a == b for a, b in zip(texts, back, strict=True)]
                columns = [batch.column(i) for i in range(len(keep))]
                columns += [pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "round_trip"])

    return narrow.mapInArrow(run, (schema + ", " if schema else "") + "n_tokens bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with the text of ``ids`` (a null list of ids is an empty text)."""
    spark = encoded.sparkSession
    ship_package(spark)
    find = _resolver(spark, model or default_model())
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in ("text", "ids")]
    narrow = encoded.select(*[F.col(c) for c in keep], F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(find())
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(lo, CHUNK_ROWS)
                texts = tool.decode(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], [*keep, "text"])

    return narrow.mapInArrow(run, (schema + ", " if schema else "") + "text string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
