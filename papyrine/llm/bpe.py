"""Byte-level BPE encoding and decoding over whole documents.

Spark splits every text into pre-tokens and counts the distinct words. Each distinct word is encoded once, into a table of
words with their ids. The frequent ones (at most MAX_WORDS, each of LONGEST bytes at most) get their bytes by a join of
their ids with the id-to-piece table, and go to the workers, where ids and bytes come back to each document by the
positions of its words. Rarer words, of which a block of documents holds few, are encoded and decoded where they occur: a
join of them by document would move every text twice.

Defined results: a null text is the empty text (0 tokens); texts may be of any length; repeated rows give repeated rows;
an empty input gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import runtime
from papyrine.llm.runtime import materialize

#: Unicode White_Space, spelled out: Java's \s is ASCII only.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pre-tokenizer's pattern (a fixed value of the public vocabulary).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words that go to the workers at most, and bytes of each.
MAX_WORDS, LONGEST = 250_000, 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_column(text, specials: list[str]):
    """array<string>: pre-tokens of a text. A special token's string is a word of its own, as in the library."""
    pieces = lambda s: F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not specials:
        return pieces(text)
    if len(specials) > 1:
        raise ValueError("one special token at most")
    mark = specials[0]
    quoted = "\\Q" + mark + "\\E"
    parts = F.split(text, quoted, -1)
    joined = F.flatten(F.transform(parts, lambda s, i: F.when(i == 0, pieces(s)).otherwise(F.concat(F.array(F.lit(mark)), pieces(s)))))
    return F.when(F.contains(text, F.lit(mark)), joined).otherwise(pieces(text))


def tokenizer_of(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def word_table(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids of each distinct word of a column words (array<string>): how often it occurs, and its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or tokenizer_of(path)
            ids = [e.ids for e in own.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.mapInArrow(runtime.trimmed(encode), "word string, n long, ids array<int>")


def spelled(table: DataFrame, path: str) -> DataFrame:
    """word, ids, raw: with the bytes that the ids stand for, by a join of the ids with the id-to-piece table."""
    pieces = id_pieces(tokenizer_of(path))
    spark = table.sparkSession
    by_id = spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pieces}))  # the vocabulary
    each = table.select("word", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(by_id), "id")
    raw = each.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    raw = raw.select("word", F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["piece"])).alias("raw"))
    return table.select("word", "ids").join(raw, "word")


def frequent(table: DataFrame, most: int | None = None) -> DataFrame:
    """The words of a word table that occur at least as often as some number, `most` of them at most."""
    most = MAX_WORDS if most is None else most
    short = table.where(F.octet_length("word") <= LONGEST)
    level = F.floor(F.log2("n") * 4)
    total, least = 0, None
    for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # 256 levels at most
        total += r.words
        if total > most:
            break
        least = r.level
    return short.where(level >= least) if least is not None else short.limit(0)


class Words:
    """The words that a worker knows. ids of word k are ids[starts[k]:][:lengths[k]]; raw the same for its bytes."""

    def __init__(self, table: pa.Table, path: str):
        table = table.combine_chunks()
        self.path, self.tokenizer = path, None
        self.known = {w: k for k, w in enumerate(table["word"].to_pylist())}
        self.ids = _flat(table["ids"].combine_chunks(), np.uint32)
        self.raw = _flat(table["raw"].combine_chunks(), np.uint8)

    def spell(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, lengths) and (bytes, lengths) of distinct words, one after the other."""
        code = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(code < 0)
        if not len(new):
            return tuple((_gather(flat, starts[code], lengths[code]), lengths[code]) for flat, starts, lengths in (self.ids, self.raw))
        if self.tokenizer is None:
            self.tokenizer = tokenizer_of(self.path)
            self.pieces = _flat(id_pieces(self.tokenizer), np.uint8)
        lists = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[k] for k in new], add_special_tokens=False)]
        own_ids, n_ids = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        flat, starts, lengths = self.pieces
        own_raw = _gather(flat, starts[own_ids], lengths[own_ids])
        n_raw = np.add.reduceat(np.append(lengths[own_ids], 0), np.cumsum(n_ids) - n_ids)
        out = []
        for (flat, starts, lengths), more, n in ((self.ids, own_ids, n_ids), (self.raw, own_raw, n_raw)):
            size = np.empty(len(code), np.int64)
            size[new] = n
            size[code >= 0] = lengths[code[code >= 0]]
            at = np.empty(len(code), np.int64)
            at[new] = len(flat) + np.cumsum(n) - n
            at[code >= 0] = starts[code[code >= 0]]
            out.append((_gather(np.concatenate([flat, more]), at, size), size))
        return tuple(out)


def _flat(lists: pa.Array, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All items of a list or binary array, where each row's start, and how many it has."""
    if pa.types.is_binary(lists.type):
        bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        return np.frombuffer(lists.buffers()[2] or b"", np.uint8), bounds[:-1], np.diff(bounds)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False).astype(kind), bounds[:-1], np.diff(bounds)


def id_pieces(tokenizer) -> pa.Array:
    """The id-to-piece table: the bytes of each id."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    added = tokenizer.get_added_tokens_decoder()
    vocab = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    out = []
    for i in range(max(vocab) + 1):
        t = vocab.get(i, "")
        out.append(t.encode() if i in added else bytes(chars[c] for c in t))
    return pa.array(out, pa.binary())


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + lengths[k]] for each k, one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return flat[at + np.repeat(starts - (ends - lengths), lengths)]


def encode_block(words: pa.ListArray, known: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """ids of all documents of a block, where each document's ids start (one more entry than documents), and the UTF-8 of
    each document's ids; bytes that are no UTF-8 become U+FFFD."""
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds, at = bounds - bounds[0], flat.indices.to_numpy()
    out = []
    for own, lengths in known.spell(flat.dictionary.to_pylist()):
        starts = np.cumsum(lengths) - lengths
        out.append((_gather(own, starts[at], lengths[at]), np.concatenate([[0], np.cumsum(lengths[at])])[bounds]))
    (ids, first), (raw, ends) = out
    return ids, first, _texts(raw, ends)


def _texts(raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
    out = raw.tobytes()
    texts = [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for k, t in enumerate(texts):
        try:
            t.decode()
        except UnicodeDecodeError:
            texts[k] = t.decode(errors="replace").encode()
    return texts


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of ids_col (array<int>; null: null), special tokens included."""
    path = path or vocabulary_path()
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            flat, starts, lengths = pieces = pieces or _flat(id_pieces(tokenizer_of(path)), np.uint8)
            own = batch.column(ids_col)
            ids, at, n = _flat(own.fill_null([]) if own.null_count else own, np.int64)
            ids, ends = ids[at[0] : at[-1] + n[-1]] if len(at) else ids[:0], np.concatenate([[0], np.cumsum(n)])
            texts = _texts(_gather(flat, starts[ids], lengths[ids]), np.concatenate([[0], np.cumsum(lengths[ids])])[ends])
            text = pa.array([t.decode() if ok else None for t, ok in zip(texts, own.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=schema.names)

    return rows.mapInArrow(runtime.trimmed(blocks), schema)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for each document; with keep also ids (array<int>) and decoded text."""
    spark = runtime.prepare(docs.sparkSession)
    path = path or vocabulary_path()
    specials = [t.content for t in tokenizer_of(path).get_added_tokens_decoder().values()]
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    words = docs.select(F.col(id_col), words_column(F.col(text_col), specials).alias("words"))
    often = spelled(frequent(materialize(word_table(words, path), "words")), path).toArrow()  # bounded by MAX_WORDS and LONGEST
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, often.schema) as out:
        out.write_table(often)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Words(pa.ipc.open_stream(shared.value).read_all(), path)
            ids, bounds, texts = encode_block(batch.column("words"), known)
            raw = ids.astype("<u4").tobytes()
            out = {
                id_col: batch.column(id_col),
                "n_tokens": pa.array(np.diff(bounds)),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            if keep:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                out["decoded"] = pa.array([t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return words.mapInArrow(runtime.trimmed(blocks), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(runtime.table(spark, sf_dir, "documents"))
